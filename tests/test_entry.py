"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


def test_imports_without_the_subpackage(tmp_path):
    import shutil

    for p in ("__spark_entry__.py", "quern"):
        src = ROOT / p
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / p)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_report' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_registered_queries_read_files_that_they_write(spark, tmp_path):
    """A reader's query and its SQL on a table with blanks, tabs and nulls in texts."""
    docs = [(1, "a b", "en", "src1", 3), (2, " \t", "en", "src1", 2), (3, None, "de", "src1", None), (4, 'quote " and \\ and 的🙂', "de", "src2", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("read_news", "read_encyclopedia", "read_community_answers", "read_parallel_sentences", "read_court_cases"):
        got = sorted(r["text"] for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == ["a b", 'quote " and \\ and 的🙂'], name
