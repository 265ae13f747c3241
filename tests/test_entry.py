import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_encoded_sizes_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    texts = [None, "", "a", "\0", "a\0b", "\r\n", "e\u0301", "\u00e9", "\U0001f600", "\U0001f1e9\U0001f1ea", "\U0010ffff", *("x" * n for n in (125, 126)), "\u4e2d" * 16384]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = e.queries()["value_encoded_size"](spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in found] == db.execute(f"{e.oracle_sql()['value_encoded_size']} order by doc_id").fetchall()


def test_training_operators_stand_apart():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tessera").parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("tessera.llm") for n in names), p
