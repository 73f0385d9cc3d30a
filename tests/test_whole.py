"""Queries over the catalogue's tables against whole results, where their SQL in the catalogue covers less."""

import datetime
import hashlib
import re

import bench
from rolescape.plans.catalog import QUERIES


def folder_of(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_the_48_hour_report_has_documents_without_a_date(spark, tmp_path):
    late, early = datetime.datetime(2024, 1, 29), datetime.datetime(2024, 1, 1)
    docs = [(1, "the urgent one", "en", "web"), (2, "the old one", "en", "web"), (3, "the urgent one without a date", "en", "web"), (4, "the plain one without a date", "en", "web"), (5, "nothing", "en", "web")]
    folder = folder_of(spark, tmp_path, documents=(docs, DOCUMENTS), events=([(1, early), (1, late), (2, early), (9, late)], "user_id long, ts timestamp"))
    rows = {tuple(r) for r in QUERIES["report_48h"](spark, folder).select("job_key", "date_status", "urgency").collect()}
    assert rows == {("1", "confirmed_48h", "urgent"), ("2", "older", "normal"), ("3", "date_unknown", "urgent"), ("4", "date_unknown", "normal")}
    assert QUERIES["report_48h_metrics"](spark, folder).first().asDict() == {"relevant": 4, "confirmed": 1, "confirmed_urgent": 1, "urgent_unknown": 1}


def test_markdown_cells_are_whole(spark, tmp_path):
    texts = ["a | b\n c", " x\t" * 150 + "| end |\n", "|" * 700, "", None]
    folder = folder_of(spark, tmp_path, documents=([(i, x, "en", "web") for i, x in enumerate(texts)], DOCUMENTS))
    cells = {r["doc_id"]: r["cell"] for r in QUERIES["markdown_escape"](spark, folder).collect()}
    assert cells == {i: re.sub(r"\s+", " ", x or "").strip().replace("|", "\\|") for i, x in enumerate(texts)}


def test_guarded_texts_are_whole(spark, tmp_path):
    texts = ["sums and words " * 20, "=1+1 " * 20, "  -2 and a long tail of words", "plain", "@a", "more than twenty characters", None]
    folder = folder_of(spark, tmp_path, documents=([(i, x, "en", "web") for i, x in enumerate(texts)], DOCUMENTS))
    safe = {r["doc_id"]: r["safe"] for r in QUERIES["formula_guard"](spark, folder).collect()}
    assert safe == {0: "'=" + texts[0], 1: "'" + texts[1], 2: "'" + texts[2], 3: "plain", 4: "'@a", 5: "'=" + texts[5], 6: None}


def test_documents_without_a_first_line_are_searchable(spark, tmp_path):
    docs = [(1, "First\nSecond", "en", "web"), (2, "\nSecond", "en", "web"), (3, "", "en", "web"), (4, None, "en", "web")]
    folder = folder_of(spark, tmp_path, documents=(docs, DOCUMENTS))
    shas = {r["job_key"]: r["searchable_sha"] for r in QUERIES["searchable_text"](spark, folder).collect()}
    want = {"1": "first web en first\nsecond", "2": "web en \nsecond", "3": "web en", "4": "web en"}
    assert shas == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_the_bench_has_the_ledger_merge():
    assert "ledger_merge" in bench.HEADLINES and set(bench.HEADLINES) <= set(QUERIES)
