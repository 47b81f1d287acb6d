import random
import re

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def llm_spark(spark):
    from vigil.llm.queries import prepare

    prepare(spark)
    return spark


def some_texts(seed=1, n=60):
    """Prose of invented words, near copies, shared lines, odd white space, nulls and one long text."""
    rng = random.Random(seed)
    words = [a + b for a in ("the", "on", "éa", "ber", "ti", "wh") for b in ("tion", "er", "ou", "ß", "que", "in,", "a.")]
    texts = [None, "", " ", "\n\n", "one", "Two words", "a b c d", "A\tB\r\nc   d", "word " * 30, "x\n" * 40]
    for k in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  Shared FOOTER line " if k % 2 else "shared footer line")
        texts.append("\n".join(lines))
        if k % 4 == 0:
            texts.append(texts[-1])
        if k % 5 == 0:
            texts.append(texts[-1] + " tail")
    texts.append(" ".join(rng.choices(words, k=9000)))
    return texts


@pytest.fixture(scope="session")
def docs_rows():
    return [(7 * k, t, "en", None if k % 11 == 0 else f"src{k % 4}", len(t or "")) for k, t in enumerate(some_texts())]


@pytest.fixture(scope="session")
def docs(llm_spark, docs_rows):
    return llm_spark.createDataFrame(docs_rows, DOC_SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "target", "row", "v", "tag", "did", "keep", "score", "node", "sig", "gid", "length", "rank", "words", "kept", "body", "copies", "u"]
    return docs.withColumns({c: F.lit("other") for c in names})


@pytest.fixture(scope="session")
def no_docs(llm_spark):
    return llm_spark.createDataFrame([], DOC_SCHEMA)
