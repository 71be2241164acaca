"""Queries against their DuckDB twins on the smallest driver tables."""

import os
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
PICKED = ["o01_scan_files", "o02_admit_files", "o05_read_text_segments", "o06_read_page_blocks", "o07_upsert_chunks", "o13_append_log", "o15_qa_events", "o20_drop_table_overlaps", "o26_equation_route", "o29_table_caption", "o31_order_blocks", "o34_is_heading_line", "o37_ocr_stats", "o42_group_segments", "o45_chunk_segments", "o48_embed_chunks", "o49_check_dim", "o50_dense_topk", "o51_exact_cosine", "o58_bm25_topk", "o66_assemble_context", "o68_answer_batch", "o69_build_sample", "o71_clean_summary", "o72_workspace_summary_due", "o73_workspace_digest", "o73_store_summary", "o77_last_messages", "o79_document_detail", "o81_qa_log_page", "o81_recent_logs", "o84_extract_citations", "o86_workspace_progress", "s02_event_log", "s03_ingest_chain"]


def test_every_query_has_a_name_and_a_function():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", PICKED)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    got = df.select(*sorted(df.columns)).collect()
    want = con.sql(f"select {', '.join(f'\"{c}\"' for c in sorted(df.columns))} from ({ORACLES[name].strip()})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(map(tuple, got)) == plain(want)


def test_without_the_folders_of_llm():
    """The rest imports and offers its queries where quern/llm, tests/llm and corpus_pipeline.py are not there."""
    top = Path(__file__).parent.parent
    place = Path(tempfile.mkdtemp(prefix="spark-"))
    shutil.copy(top / "__spark_entry__.py", place)
    shutil.copytree(top / "quern", place / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith(('op', 'pipeline'))] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=place, env={**os.environ, "PYTHONPATH": str(place)}, check=True, timeout=100)
