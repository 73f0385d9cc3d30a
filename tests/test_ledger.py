"""The ledger against a plain sequential version, batch by batch, and as a versioned store."""

import hashlib
import random
from pathlib import Path

import pytest

from rolescape import cli, schemas, shared


from rolescape.operators import ledger
from rolescape.store import Store

TEXT = {c: "" for c in schemas.LEDGER.names if c != "match_score"} | schemas.DEFAULTS | {"match_score": 0}


def row(**values):
    return TEXT | {"title": "Designer", "company": "Acme"} | values


def frame(spark, rows):
    from pyspark.sql import types as T

    kinds = T.StructType([*schemas.JOB.fields, T.StructField("seq", T.LongType())])
    return spark.createDataFrame([tuple(r[f.name] for f in kinds.fields) for r in rows], kinds)


class Plain:
    """One row after the other, over dictionaries: what the merge has to equal."""

    def __init__(self):
        self.jobs, self.aliases = {}, {}

    def upsert(self, new):
        fp, url = new["identity_fingerprint"], new["canonical_url"]
        fits = lambda k: k in self.jobs and (not url or self.jobs[k]["canonical_url"] == url)
        key = None
        if new["job_key"] in self.jobs:
            own = self.jobs[new["job_key"]]["canonical_url"]
            key = new["job_key"] if not own or not url or own == url else None
        for kind, value in (("canonical_url", url), ("fingerprint", fp)):
            found = [k for t, v, k in self.aliases if (t, v) == (kind, value) and fits(k)] if value and key is None else []
            key = found[0] if len(found) == 1 else key
        if key is None:
            key = new["job_key"] or fp
            if key in self.jobs and self.jobs[key]["canonical_url"] != url:
                key = hashlib.sha256("|".join([key, "variant", url or "|".join(new[c] for c in ("source_name", "apply_url", "source_url"))]).encode()).hexdigest()
        action = "updated" if key in self.jobs else "new"
        old = self.jobs.get(key)
        if old is None:
            self.jobs[key] = new | {"job_key": key}
        else:
            scored = new["match_reasons"] or new["gaps"]
            out = dict(old)
            for c in ledger.REFRESHED:
                out[c] = new[c] or old[c]
            for c in ledger.DERIVED:
                out[c] = new[c] if scored or new[c] else old[c]
            for c in ledger.SCORED:
                out[c] = new[c] if scored else old[c]
            if new["duplicate_status"] not in ("", "unique"):
                out["duplicate_status"] = new["duplicate_status"]
            out |= {"identity_fingerprint": fp, "canonical_url": url or old["canonical_url"], "last_seen_at": new["last_seen_at"]}
            self.jobs[key] = out
        for kind, value in (("fingerprint", fp), ("canonical_url", url)):
            if value:
                self.aliases.setdefault((kind, value, key), new["found_at"])
        return key, action


def identified(spark, rows):
    """The rows with fingerprint and URL as the library computes them; those functions have tests of their own."""
    return [r.asDict() for r in ledger.identified(frame(spark, rows), "seq").orderBy("seq").collect()]


def state(store, version=None):
    jobs = {r["job_key"]: r.asDict() for r in store.read("jobs", version=version).collect()}
    aliases = {(r["alias_type"], r["alias_value"], r["job_key"]): r["first_seen_at"] for r in store.read("job_identity_aliases", version=version).collect()}
    return jobs, aliases


def batches(rng, n, size):
    """Rows over few titles, texts, URLs and keys, so that identities meet, chain, clash and become ambiguous."""
    seq = 0
    for b in range(n):
        rows = []
        for _ in range(size):
            seq += 1
            rows.append(row(seq=seq, title=rng.choice(["Designer", "designer!", "Checker"]), description=rng.choice(["", "a", "b", "c"]), apply_url=rng.choice(["", "", "https://x.example/1", "https://x.example/2/", "https://x.example/3?utm_a=b"]), job_key=rng.choice(["", "", "", "k1", "k2"]), source_name=rng.choice(["s", "t"]), location=rng.choice(["", "here"]), city=rng.choice(["", "Pune"]), gaps=rng.choice(["", "", "g"]), match_score=rng.randrange(9), duplicate_status=rng.choice(["unique", "twin"]), found_at=f"{b}-{seq}", last_seen_at=f"{b}-{seq}"))
        yield rows


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_the_sequential_version(spark, tmp_path, seed):
    store, plain = Store(spark, str(tmp_path / "ledger"), buckets=3), Plain()
    for number, rows in enumerate(batches(random.Random(seed), 3, 14)):
        rng = random.Random(seed)
        shuffled = rng.sample(rows, len(rows))
        events = {r["seq"]: (r["job_key"], r["action"]) for r in store.upsert(frame(spark, shuffled).repartition(3)).collect()}
        assert events == {r["seq"]: plain.upsert({c: r[c] for c in schemas.LEDGER.names}) for r in identified(spark, rows)}
        jobs, aliases = state(store)
        assert jobs == plain.jobs and aliases == plain.aliases
        assert store.current() == number + 1


def test_an_alias_of_a_row_merged_away_is_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = row(description="first text", apply_url="https://x.example/1")
    store.upsert(frame(spark, [one | {"seq": 1}, one | {"seq": 2, "description": "second text"}]))
    again = store.upsert(frame(spark, [one | {"seq": 3, "apply_url": ""}])).collect()
    assert [r["action"] for r in again] == ["updated"] and store.read("jobs").count() == 1 and store.read("job_identity_aliases").count() == 3


def test_only_touched_buckets_are_written_and_marks_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    store.upsert(frame(spark, [row(seq=i, job_key=f"k{i}", title=f"t{i}") for i in range(40)]), mark="a:0")
    before = store.manifest()
    assert store.upsert(frame(spark, [row(seq=1, job_key="k1", title="t1", last_seen_at="9")]), mark="a:1").count() == 1
    after = store.manifest()
    assert len([k for k in after if k[0] == "jobs" and after[k] != before.get(k)]) == 1
    assert len([k for k in after if k[0] == "job_identity_aliases" and after[k] != before.get(k)]) == 1
    # a batch that is run again changes nothing; another writer's is its own
    assert store.upsert(frame(spark, [row(seq=1, job_key="k1")]), mark="a:1").count() == 0 and store.current() == 2
    assert store.upsert(frame(spark, [row(seq=1, job_key="k1")]), mark="b:0").count() == 1 and store.batches() == {"a:1", "b:0"}
    assert store.read("jobs", version=1).where("last_seen_at = '9'").count() == 0 and store.read("jobs").count() == 40


def test_texts_are_written_once_for_each_batch(spark, tmp_path, monkeypatch):
    rng, size = random.Random(5), 40_000
    long = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size))
    places = [tmp_path, Path(shared.folder(spark, "x").removeprefix("file://")).parent]
    used = lambda: sum(f.stat().st_size for p in places for f in p.rglob("*.parquet"))
    store, before = Store(spark, str(tmp_path), buckets=2), used()
    one = [row(seq=i, job_key=f"k{i}", title=f"t{i}", description=long()) for i in range(10)]
    store.upsert(frame(spark, one))
    two = [one[0] | {"description": long()}, one[1] | {"description": "", "title": "Changed"}]
    monkeypatch.setattr("rolescape.store.LANDED", 1)
    events = store.upsert(frame(spark, two))
    # 11 long texts are landed, and 10 of them gathered; before, a text was in five files after its first batch
    assert used() - before < 21.5 * size
    assert {r["seq"]: r["description"] for r in events.collect()} == {r["seq"]: r["description"] for r in two}
    want = {r["job_key"]: r["description"] for r in one}
    texts = lambda version: {r["job_key"]: r["description"] for r in store.read("jobs", version=version, columns=["job_key", "description"]).collect()}
    assert texts(1) == want and texts(2) == texts(3) == want | {"k0": two[0]["description"]}
    assert store.current() == 3 and len([k for k in store.manifest() if k[0] == "job_texts"]) == 1


def test_rows_that_hold_their_description_are_merged(spark, tmp_path):
    store, old = Store(spark, str(tmp_path), buckets=2), row(seq=1, job_key="k", description="@1:1 =")
    whole = ledger.identified(frame(spark, [old, old | {"seq": 2, "job_key": "q", "title": "Other"}]))
    store.publish(store.put("jobs", whole), 0)  # a ledger whose rows name no texts
    store.upsert(frame(spark, [old | {"description": "", "city": "Pune"}, row(seq=2, job_key="n", description="=new")]))
    assert {(r["job_key"], r["city"], r["description"]) for r in store.read("jobs").collect()} == {("k", "Pune", "@1:1 ="), ("q", "", "@1:1 ="), ("n", "", "=new")}


def test_a_batch_that_fails_between_tables_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.upsert(frame(spark, [row(seq=1, job_key="k")]))
    before, put = state(store), Store.put

    def fails(self, table, df):
        if table == "job_identity_aliases":
            raise RuntimeError("lost")
        return put(self, table, df)

    monkeypatch.setattr(Store, "put", fails)
    with pytest.raises(RuntimeError):
        store.upsert(frame(spark, [row(seq=2, job_key="k", title="Changed"), row(seq=3, job_key="n")]))
    assert state(store) == before and store.current() == 1
    with pytest.raises(Exception, match="title and company"):
        store.upsert(frame(spark, [row(seq=2, job_key="x"), row(seq=3, title=" ")]))
    monkeypatch.undo()
    assert state(store) == before and store.upsert(frame(spark, [row(seq=2, job_key="n")])).count() == 1


def test_two_writers_cannot_publish_the_same_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({("jobs", 0): "jobs/u=1/bucket=0"}, 0)
    with pytest.raises(Exception, match="(?i)exists"):
        store.publish({}, 0)


def test_stars_of_chains_cycles_and_hubs(spark):
    rng = random.Random(1)
    chain = [(i + 1, i) for i in range(100, 140)]
    hub = [(i, 7) for i in range(200, 230)]
    loose = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = {(max(e), min(e)) for e in chain + hub + loose if e[0] != e[1]}
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["a"]: r["b"] for r in ledger.stars(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert found == {a: b for a, b in root.items() if a != b}
    assert ledger.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_collect_export_and_verify_from_the_command_line(spark, tmp_path, capsys):
    import json

    posting = lambda i, title: {"id": i, "title": title, "absolute_url": f"https://b.example/{i}", "location": {"name": "Pune"}, "content": "text"}
    for n, jobs in enumerate(([posting(1, "Piping Engineer"), posting(2, "Checker")], [posting(2, "Checker II"), posting(3, "Lead")])):
        spark.createDataFrame([("board", "Acme", json.dumps({"jobs": jobs}))], "source_name string, company string, payload string").write.parquet(str(tmp_path / f"landed{n}"))
        assert cli.main(["collect", "greenhouse", str(tmp_path / f"landed{n}"), str(tmp_path / "root"), "--as-of", "2026-08-01"]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["new 2, updated 0", "new 1, updated 1"]
    assert cli.main(["verify", str(tmp_path / "root")]) == 0 and cli.main(["export", str(tmp_path / "root"), str(tmp_path / "out")]) == 0
    assert {r["title"] for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "representatives")).collect()} == {"Piping Engineer", "Checker II", "Lead"}
