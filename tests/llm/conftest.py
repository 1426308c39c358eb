import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LONG = "\n".join(f"word{i} tail{i % 97} of line {i}" for i in range(9000))


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows of ``documents`` beside NULLs in every column, empty and very long texts, repeated rows, and further
    columns whose names the operators use themselves."""
    odd = [(None, "a text without an id but with some words in it", "en", "src0", 46), (9001, None, "en", "src1", None), (9002, "", None, "src1", 0),
           (9003, " \n\t ", "de", None, 4), (9004, LONG, "en", None, len(LONG)), (9005, "!!! ??? 123", None, None, 11),
           (9006, "one", "en", "src2", 3), (9007, "same words here again for a tie of two rows", "en", "src2", 44),
           (9008, "same words here again for a tie of two rows", "en", "src2", 44), (9008, "same words here again for a tie of two rows", "en", "src2", 44),
           (9009, "\U0001f600 éè 你好 \x0b\x0c end", "fr", "src3", 17)]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    for name in ("y", "score", "node", "b", "n", "term", "key", "class_id", "kept", "label", "bucket", "measure", "rate", "held_out", "item_id", "section"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


@pytest.fixture(scope="session")
def labels(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = [(None, 1, 0), (9004, None, None), (9001, 0, 1), (9007, 1, 0), (9007, 1, 0)]
    return base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("text", F.lit("clash")).cache()


def empty(df):
    return df.where(F.lit(False))
