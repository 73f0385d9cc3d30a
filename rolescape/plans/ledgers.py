"""Named queries over ledgers that the queries write themselves: identities over two batches, and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescape import imports, shared
from rolescape.plans.adapters import table
from rolescape.plans.catalog import FIRST_LINE, NORM, query
from rolescape.store import Store


def _print(body: str) -> str:
    return "sha256(" + " || '|' || ".join(NORM.format(c) for c in ("title", "source", "lang", body)) + ")"


def _row(kind: str, key: str, said: str = "''", value: str = "''", seq: str = "CAST(NULL AS BIGINT)") -> str:
    return f"{{'kind': '{kind}', 'seq': {seq}, 'job_key': {key}, 'said': {said}, 'value': {value}}}"


def _event(key: str, said: str, nth: int = 0) -> str:
    return _row("event", key, f"'{said}'", seq=f"CAST(n * 4 + {nth} AS BIGINT)")


def _job(key: str, url: str) -> str:
    return _row("job", key, value=url)


def _aliases(key: str, *values: str) -> list[str]:
    return [_row("alias", key, "'canonical_url'" if v in ("u", "w") else "'fingerprint'", v) for v in values]


#: What the two batches come to, by class: found by URL, by fingerprint, by an alias that a row merged away brought, an
#: ambiguous fingerprint, an explicit key that gains a URL, a URL that does not attach to a row without one, a chain inside
#: the second batch, an explicit key whose row has another URL.
_CLASSES = [
    [_event("a", "updated"), _job("a", "u"), *_aliases("a", "a", "b", "u")],
    [_event("a", "updated"), _job("a", "''"), *_aliases("a", "a")],
    [_event("a", "updated"), _job("a", "u"), *_aliases("a", "a", "b", "u")],
    [_event("a", "updated"), _job("a", "''"), _job("v", "u"), *_aliases("a", "a"), *_aliases("v", "a", "u")],
    [_event("k", "updated"), _job("k", "u"), *_aliases("k", "a", "b", "u")],
    [_event("v", "new"), _job("a", "''"), _job("v", "u"), *_aliases("a", "a"), *_aliases("v", "a", "u")],
    [_event("a", "updated"), _event("a", "updated", 1), _event("e", "new", 2), _job("a", "u"), _job("e", "''"), *_aliases("a", "a", "b", "u"), *_aliases("e", "e")],
    [_event("x", "new"), _job("k", "u"), _job("x", "w"), *_aliases("k", "a", "u"), *_aliases("x", "a", "w")],
]


def _batch(d, *cases):
    """Rows of a batch: for each class the (text's suffix, URL's suffix or None, whether the key is given), in order."""
    case = lambda nth, suffix, url, keyed: F.struct(F.lit(nth).alias("nth"), F.lit(suffix).alias("suffix"), F.lit(url).cast("string").alias("url"), F.lit(keyed).alias("keyed"))
    of = F.lit(None)
    for c, rows in enumerate(cases):
        of = F.when(F.col("n") % 8 == c, F.array(*[case(nth, *row) for nth, row in enumerate(rows)])).otherwise(of)
    number = F.col("n").cast("string")
    return d.withColumn("case", F.explode(of)).select(
        (F.col("n") * 4 + F.col("case.nth")).alias("seq"), "title", F.col("source").alias("company"), F.col("lang").alias("location"), F.concat("body", "case.suffix").alias("description"),
        F.when(F.col("case.url").isNotNull(), F.concat(F.lit("https://example.com/jobs/"), number, "case.url")).otherwise("").alias("apply_url"), F.when(F.col("case.keyed"), F.concat(F.lit("K"), number)).otherwise("").alias("job_key"),
    )


@query(f"""WITH d AS (SELECT doc_id AS n, 'Role ' || doc_id || ' ' || {FIRST_LINE} AS title, source, lang, coalesce(text, '') AS body, coalesce(text, '') || ' second' AS body2, coalesce(text, '') || ' third' AS body3, 'https://example.com/jobs/' || doc_id AS u FROM documents WHERE source <> ''),
 f AS (SELECT n, u, u || 'z' AS w, 'K' || n AS k, {_print('body')} AS a, {_print('body2')} AS b, {_print('body3')} AS e FROM d),
 g AS (SELECT *, sha256(a || '|variant|' || u) AS v, sha256(k || '|variant|' || w) AS x FROM f)
 SELECT r.kind, r.seq, r.job_key, r.said, r.value FROM (SELECT unnest(CASE {' '.join(f'WHEN n % 8 = {c} THEN [{", ".join(rows)}]' for c, rows in enumerate(_CLASSES))} END) AS r FROM g)""")
def ledger_two_batches(spark, d):
    docs = table(spark, d, "documents").where("source <> ''")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("n"), F.concat(F.lit("Role "), F.col("doc_id").cast("string"), F.lit(" "), F.left(F.substring_index(body, "\n", 1), F.lit(80))).alias("title"), "source", "lang", body.alias("body"))
    store = Store(spark, shared.folder(spark, "two-batches"), buckets=8)
    one, two = ("", "", False), ("", None, False)
    store.upsert(_batch(rows, [one], [two], [one, (" second", "", False)], [two, one], [("", None, True)], [two], [one], [("", "", True)]))
    events = store.upsert(_batch(rows, [(" second", "", False)], [two], [two], [two], [(" second", "", True)], [one], [(" second", "", False), (" second", None, False), (" third", None, False)], [("", "z", True)]))
    none = F.lit(None).cast("long")
    out = events.select(F.lit("event").alias("kind"), "seq", "job_key", F.col("action").alias("said"), F.lit("").alias("value"))
    out = out.unionByName(store.read("jobs", columns=["job_key", "canonical_url"]).select(F.lit("job").alias("kind"), none.alias("seq"), "job_key", F.lit("").alias("said"), F.col("canonical_url").alias("value")))
    return out.unionByName(store.read("job_identity_aliases").select(F.lit("alias").alias("kind"), none.alias("seq"), "job_key", F.col("alias_type").alias("said"), F.col("alias_value").alias("value")))


@query("""WITH t AS (SELECT sha256(text) AS h, min(doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY text),
 imports AS (SELECT h, n, CASE WHEN n % 7 = 0 THEN 'staged' ELSE 'complete' END AS status, 'k' || n AS job_key, n % 11 <> 0 AS job, 'e/' || n AS place, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 5 = 0 THEN sha256(h) ELSE h END AS bytes FROM t WHERE n % 10 < 7),
 files AS (SELECT sha256(text) AS h, min('in/' || doc_id) AS path FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1)
 SELECT coalesce(files.h, imports.h) AS sha256, coalesce(path, '') AS path, coalesce(place, '') AS stored_path, coalesce(job_key, '') AS job_key,
  CASE WHEN status IS NULL THEN 'new' WHEN status = 'staged' OR NOT job THEN CASE WHEN path IS NULL THEN 'stale' ELSE 'retry' END WHEN bytes = imports.h THEN CASE WHEN path IS NULL THEN 'kept' ELSE 'duplicate' END
  ELSE CASE WHEN path IS NULL THEN 'lost_' ELSE 'repair_' END || CASE WHEN bytes IS NULL THEN 'missing' ELSE 'corrupt' END END AS state FROM files FULL JOIN imports ON files.h = imports.h""")
def import_reconciliation(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("sha256", F.sha2("text", 256))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("n"))
    number = F.col("n").cast("string")
    known = first.where("n % 10 < 7").select("n", "sha256", F.concat(F.lit("e/"), number).alias("stored_path"), F.concat(F.lit("k"), number).alias("job_key"), F.when(F.col("n") % 7 == 0, "staged").otherwise("complete").alias("status"))
    listing = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), "sha256")
    evidence = known.where("n % 4 <> 0").select("stored_path", F.when(F.col("n") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return imports.reconcile(known, listing, evidence, known.where("n % 11 <> 0").select("job_key"))

