"""The ledger: identities, the order-dependent merge of incoming rows, aliases and source health.

An incoming row finds its stored row by explicit key, else by the one alias with its URL, else by the one with its
fingerprint, and each row sees those merged before it. Rows that share no key, URL or fingerprint cannot affect each
other, so the batch and the stored rows it reaches are split into connected groups, and each group is folded in arrival
order. Identities are compared as 64-bit hashes for the grouping alone: a collision joins two groups, which changes no
result. An incoming row that shares nothing is new without a fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescape import schemas
from rolescape.functions.text import first_filled, normalize, text
from rolescape.functions.urls import canonical
from rolescape.operators.dedup import best_per
from rolescape.shared import written

#: Columns that a filled incoming value refreshes, and those that a scored row overwrites.
REFRESHED = ("title", "company", "location", "description", "apply_url", "source_url", "source_name", "published_at", "job_type", "salary_text", "experience_text", "skills_text", "agency_name", "recruiter_name", "recruiter_email", "contact_source_url", "contact_confidence")
DERIVED = ("normalized_role", "city", "country", "closing_at", "employment_type", "software_text", "sector")
SCORED = ("match_score", "match_reasons", "gaps", "priority")


def fingerprint(df: DataFrame) -> Column:
    """SHA-256 over the normalized title, company, location and description."""
    return F.sha2(F.concat_ws("|", *[normalize(df[c]) for c in ("title", "company", "location", "description")]), 256)


def identified(jobs: DataFrame, seq: str | None = None) -> DataFrame:
    """Rows of the job schema (and the arrival number) with identity_fingerprint and canonical_url; a blank title or
    company stops the batch."""
    schema = schemas.JOB if seq is None else T.StructType([*schemas.JOB.fields, T.StructField(seq, T.LongType())])
    df = schemas.conform(jobs, schema)
    checked = F.when((F.trim("title") == "") | (F.trim("company") == ""), F.raise_error(F.lit("title and company are required"))).otherwise(F.col("title"))
    return df.withColumns({"title": checked, "identity_fingerprint": fingerprint(df), "canonical_url": canonical(first_filled(df["apply_url"], df["source_url"]))})


def variant_key(base: Column, disambiguator: Column) -> Column:
    return F.sha2(F.concat_ws("|", base, F.lit("variant"), disambiguator), 256)


def alias_pairs(fingerprint: Column, url: Column) -> Column:
    """The aliases of a row as an array of (alias_type, alias_value); an empty value is none."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("alias_type"), value.alias("alias_value"))
    return F.filter(F.array(pair("fingerprint", fingerprint), pair("canonical_url", url)), lambda p: p["alias_value"] != "")


def aliases_of(ledger: DataFrame) -> DataFrame:
    """fingerprint and URL aliases of stored rows as they are now, first seen when found; for ledgers without aliases."""
    rows = ledger.select(F.explode(alias_pairs(F.col("identity_fingerprint"), F.col("canonical_url"))).alias("p"), "job_key", F.col("found_at").alias("first_seen_at"))
    return rows.select("p.*", "job_key", "first_seen_at").groupBy("alias_type", "alias_value", "job_key").agg(F.min("first_seen_at").alias("first_seen_at"))


def alias_events(merged: DataFrame) -> DataFrame:
    """The aliases that a merged batch registers: those of every incoming row under the key it got, first seen when the
    first of them was found."""
    rows = merged.where("action <> 'stored'").select(F.explode(alias_pairs(F.col("identity_fingerprint"), F.col("canonical_url"))).alias("p"), "job_key", "found_at", "seq")
    return rows.select("p.*", "job_key", "found_at", "seq").groupBy("alias_type", "alias_value", "job_key").agg(F.min_by("found_at", "seq").alias("first_seen_at"))


def add_aliases(aliases: DataFrame, more: DataFrame) -> DataFrame:
    """Insert or ignore: what is there stays."""
    both = aliases.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return both.groupBy("alias_type", "alias_value", "job_key").agg(F.min_by("first_seen_at", "_late").alias("first_seen_at"))


def migrate(old: DataFrame) -> DataFrame:
    """A ledger of an older schema with every column, fingerprints and URLs filled in, keys kept."""
    df = schemas.conform(old, schemas.LEDGER)
    return df.withColumns({"identity_fingerprint": first_filled(df["identity_fingerprint"], fingerprint(df)), "canonical_url": first_filled(df["canonical_url"], canonical(first_filled(df["apply_url"], df["source_url"])))})


def merge_values(stored: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
    """A stored row refreshed by an incoming one; status and found_at stay, scored rows overwrite what is derived."""
    out, scored = dict(stored), bool(new["match_reasons"] or new["gaps"])
    for c in REFRESHED:
        out[c] = new[c] or stored[c]
    for c in DERIVED:
        out[c] = new[c] if scored else new[c] or stored[c]
    if scored:
        out.update({c: new[c] for c in SCORED})
    if new["duplicate_status"] not in ("", "unique"):
        out["duplicate_status"] = new["duplicate_status"]
    return out | {"identity_fingerprint": new["identity_fingerprint"], "canonical_url": new["canonical_url"] or stored["canonical_url"], "last_seen_at": new["last_seen_at"]}


class Group:
    """The stored rows and aliases of one connected group, folded over its incoming rows."""

    def __init__(self):
        self.rows: dict[str, dict[str, Any]] = {}
        self.aliases: dict[tuple[str, str], set[str]] = {}

    def only(self, kind: str, value: str, url: str) -> str | None:
        """The single row with an alias; one that has no URL or another doesn't take an incoming URL."""
        keys = [k for k in self.aliases.get((kind, value), ()) if k in self.rows and (not url or self.rows[k]["canonical_url"] == url)] if value else []
        return keys[0] if len(keys) == 1 else None

    def find(self, new: dict[str, Any]) -> str | None:
        url, asked = new["canonical_url"], self.rows.get(new["job_key"])
        if asked is not None and (not asked["canonical_url"] or not url or asked["canonical_url"] == url):
            return new["job_key"]
        return self.only("canonical_url", url, url) or self.only("fingerprint", new["identity_fingerprint"], url)

    def free_key(self, new: dict[str, Any]) -> str:
        base = new["job_key"] or new["identity_fingerprint"]
        if base not in self.rows or self.rows[base]["canonical_url"] == new["canonical_url"]:
            return base
        other = new["canonical_url"] or "|".join(new[c] for c in ("source_name", "apply_url", "source_url"))
        return hashlib.sha256(f"{base}|variant|{other}".encode()).hexdigest()

    def upsert(self, new: dict[str, Any]) -> tuple[str, str]:
        """Merge a row; its key and whether it was new."""
        key = self.find(new) or self.free_key(new)
        action = "updated" if key in self.rows else "new"
        self.rows[key] = merge_values(self.rows[key], new) if key in self.rows else dict(new, job_key=key)
        for kind, value in (("fingerprint", new["identity_fingerprint"]), ("canonical_url", new["canonical_url"])):
            if value:
                self.aliases.setdefault((kind, value), set()).add(key)
        return key, action


def stars(edges: DataFrame) -> DataFrame:
    """(a, b), b the smallest number connected with a, for every a that has a smaller one; edges are (a, b) with a > b.

    Large and small stars in turn until only stars are left: each number's neighbours are hung on the smallest of them,
    the larger ones first, then the smaller. The edges stay as many, and the rounds grow with the logarithm of a chain.
    """
    while True:
        edges = written(edges, "stars")
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("low"))
        edges = both.join(low, "a").where("b > a AND b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        rest = edges.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = least.select("a", F.col("low").alias("b")).unionByName(rest).distinct()


def connected(rows: DataFrame) -> DataFrame:
    """(id, group) of the rows (id, token) that share a token with another id, directly or through others."""
    met = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    links = written(rows.join(met, "token", "left_semi"), "links")
    least = links.groupBy("id").agg(F.min("token").alias("low"))
    found = stars(links.join(least, "id").where("token > low").select(F.col("token").alias("a"), F.col("low").alias("b")).distinct())
    out = least.join(found.select(F.col("a").alias("low"), F.col("b").alias("group")), "low", "left")
    return written(out.select("id", F.coalesce("group", "low").alias("group")), "groups")


def token(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def folded(dealt: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of group, part, seq, alias_type, alias_value and the ledger's columns, folded group by group.

    Rows arrive sorted by group, part (0 stored, 1 alias, 2 incoming) and arrival, so a task holds one group's stored rows
    at a time; its incoming rows pass through.
    """
    names = schemas.LEDGER.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, group, at, out = to_arrow_schema(schema), Group(), None, []

        def close() -> None:
            out.extend(r | {"seq": None, "action": "stored"} for r in group.rows.values())

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != at:
                    close()
                    group, at = Group(), r["group"]
                if r["part"] == 1:
                    group.aliases.setdefault((r["alias_type"], r["alias_value"]), set()).add(r["job_key"])
                    continue
                row = {c: r[c] for c in names}
                if r["part"] == 0:
                    group.rows[row["job_key"]] = row
                else:
                    key, action = group.upsert(row)
                    out.append(row | {"job_key": key, "seq": r["seq"], "action": action})
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return dealt.repartition("group").sortWithinPartitions("group", "part", "seq").mapInArrow(run, schema)


def incoming_tokens(new: DataFrame) -> Column:
    """The identities by which an identified row can reach stored rows or be reached, as an array of numbers."""
    base, url = first_filled(new["job_key"], new["identity_fingerprint"]), new["canonical_url"]
    other = variant_key(base, first_filled(url, F.concat_ws("|", new["source_name"], new["apply_url"], new["source_url"])))
    return F.array_distinct(F.array_compact(F.array(token("key", base), token("fingerprint", new["identity_fingerprint"]), F.when(url != "", token("canonical_url", url)), token("key", other))))


def merge(ledger: DataFrame, aliases: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Every stored row after the batch and, for each incoming row, its action.

    incoming has the job columns and an arrival number. The result has the ledger's columns and seq, action: seq is
    null and action is stored for ledger rows, else the row repeats the incoming one's outcome with action new or
    updated and its job_key. Rows that no incoming one shares an identity with pass by without entering a group. The
    batch and what it reaches are written to the shared folder once.
    """
    return merge_identified(ledger, aliases, written(identified(incoming, seq).withColumnRenamed(seq, "seq"), "incoming"))


def merge_identified(ledger: DataFrame, aliases: DataFrame, new: DataFrame) -> DataFrame:
    """merge() of rows that have their fingerprints and URLs. Of the description it only asks whether it is empty, so both
    sides may hold a name of the text instead."""
    columns, blank = schemas.LEDGER.names, F.lit(None)
    own = written(new.select(F.col("seq").alias("id"), F.explode(incoming_tokens(new)).alias("token")), "tokens")
    asked = own.select("token").distinct()
    linked = aliases.withColumn("token", F.xxhash64("alias_type", "alias_value")).join(asked, "token", "left_semi")
    by_key = ledger.select("job_key", token("key", F.col("job_key")).alias("token")).join(asked, "token", "left_semi")
    met = written(by_key.unionByName(linked.select("job_key", "token")).distinct(), "met").withColumn("id", token("stored", F.col("job_key")))
    groups = connected(own.unionByName(met.select("id", "token")))

    near = met.select("job_key", "id").distinct().join(groups, "id").select("job_key", "group")
    none = {"alias_type": blank.cast("string"), "alias_value": blank.cast("string")}
    stored = ledger.select(*columns).join(near, "job_key").select(*columns, "group", F.lit(0).alias("part"), blank.cast("long").alias("seq")).withColumns(none)
    links = linked.join(near, "job_key").select(*[F.col("job_key") if f.name == "job_key" else blank.cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields], "group", F.lit(1).alias("part"), blank.cast("long").alias("seq"), "alias_type", "alias_value")
    coming = new.join(groups.withColumnRenamed("id", "seq"), "seq", "left")
    dealt = stored.unionByName(links).unionByName(coming.where("group IS NOT NULL").select(*columns, "group", F.lit(2).alias("part"), "seq").withColumns(none))
    schema = T.StructType([*schemas.LEDGER.fields, T.StructField("seq", T.LongType()), T.StructField("action", T.StringType())])

    # a row that shares nothing is stored under its own key, and is its own event
    alone = coming.where("group IS NULL").withColumn("job_key", first_filled(F.col("job_key"), F.col("identity_fingerprint")))
    twice = F.explode(F.array(F.struct(blank.cast("long").alias("seq"), F.lit("stored").alias("action")), F.struct(F.col("seq"), F.lit("new").alias("action"))))
    alone = alone.select(*columns, twice.alias("e")).select(*columns, "e.seq", "e.action")
    untouched = ledger.join(near, "job_key", "left_anti").select(*columns, blank.cast("long").alias("seq"), F.lit("stored").alias("action"))
    return untouched.unionByName(alone).unionByName(folded(dealt, schema))


def stored_rows(merged: DataFrame) -> DataFrame:
    return merged.where("action = 'stored'").drop("seq", "action")


def counts(merged: DataFrame) -> DataFrame:
    """How many incoming rows were new and how many updated one."""
    return merged.agg(F.count_if(F.col("action") == "new").alias("new"), F.count_if(F.col("action") == "updated").alias("updated"))


def resolve(incoming: DataFrame, ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """incoming rows (with id, fingerprint and URL) and the stored key each would match, or null; ambiguity is no match."""
    url = F.col("canonical_url")
    base = incoming.select("id", F.col("job_key").alias("asked"), F.col("identity_fingerprint").alias("fp"), url.alias("url"))
    own = ledger.select("job_key", F.col("canonical_url").alias("stored_url"))
    by_key = base.join(own, F.col("asked") == F.col("job_key")).where("stored_url = '' OR url = '' OR stored_url = url").select("id", F.col("job_key").alias("k1"))
    linked = aliases.join(own, "job_key")

    def one(kind: str, value: str, name: str) -> DataFrame:
        hit = base.join(linked.where(F.col("alias_type") == kind), F.col(value) == F.col("alias_value")).where(f"{value} <> '' AND (url = '' OR stored_url = url)")
        return hit.groupBy("id").agg(F.count_distinct("job_key").alias("n"), F.min("job_key").alias(name)).where("n = 1").drop("n")

    out = base.join(by_key, "id", "left").join(one("canonical_url", "url", "k2"), "id", "left").join(one("fingerprint", "fp", "k3"), "id", "left")
    return out.select("id", F.coalesce("k1", "k2", "k3").alias("match"))


def health_latest(attempts: DataFrame) -> DataFrame:
    """The state of each source after its attempts (source_id, source_name, at, status, records_found, error_message).

    The last success stays when later attempts fail. Attempts at one moment are ordered by status.
    """
    order = F.struct("at", "status")
    ok = F.col("status").isin("pass", "pass_with_warnings")
    return attempts.groupBy("source_id").agg(F.max_by("source_name", order).alias("source_name"), F.max("at").alias("last_attempt_at"), F.max(F.when(ok, F.col("at"))).alias("last_success_at"), F.max_by("status", order).alias("status"), F.max_by("records_found", order).cast("int").alias("records_found"), F.left(text(F.max_by("error_message", order)), F.lit(1000)).alias("error_message"))


def replace_by_key(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of parts in which a later part's row replaces an earlier one's; columns missing in one are null."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    columns = [c for c in out.columns if c not in (*keys, "_part")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_part").alias("r")).select(*keys, "r.*")


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace: of rows with one key the latest counts."""
    return best_per(rows, key, F.desc(order))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not to be deleted."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def flag_review(jobs: DataFrame, review: Column) -> DataFrame:
    """New rows that need a look are marked; other statuses stay."""
    return jobs.withColumn("application_status", F.when((F.col("application_status") == "new") & review, "review_required").otherwise(F.col("application_status")))


def import_states(events: DataFrame) -> DataFrame:
    """The state of each imported file (sha256) from its events (sha256, status, job_key, at): complete once any event says
    so, else staged and to be done again; its job is that of the last complete event."""
    done = F.col("status") == "complete"
    out = events.groupBy("sha256").agg(F.max(F.when(done, F.struct("at", "job_key"))).alias("last"), F.min("at").alias("first_at"), F.count("*").alias("attempts"))
    return out.select("sha256", F.when(F.col("last").isNotNull(), "complete").otherwise("staged").alias("status"), F.coalesce("last.job_key", F.lit("")).alias("job_key"), "first_at", "attempts")


def run_rows(events: DataFrame) -> DataFrame:
    """A row for each run from its events (run_id, at, status, error_message): the last status, and the errors joined by " | "."""
    told = F.array_sort(F.collect_list(F.when(F.col("error_message") != "", F.struct("at", F.left("error_message", F.lit(2000)).alias("m")))))
    return events.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.max(F.struct("at", "status")).alias("last"), told.alias("told")).select("run_id", "started_at", "ended_at", F.col("last.status").alias("status"), F.array_join(F.transform("told", lambda x: x["m"]), " | ").alias("error_message"))


def in_shape(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source's rows in the target's columns: those that both have, the others null."""
    return source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields])
