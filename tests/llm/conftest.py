"""Small tables with every awkward case: nulls in all columns, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in la der que ist answer house stupid river stone light water green slow".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "en", "ion", ","]) for _ in range(n))


def documents() -> list[tuple]:
    rng = random.Random(4)
    rows: list[tuple] = []
    base = [prose(rng, 60) for _ in range(6)]
    for i in range(120):
        kind = i % 6
        if kind == 0:
            text = base[i % 5]
        elif kind == 1:
            w = base[i % 4].split()
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        elif kind == 2:
            text = prose(rng, rng.randint(1, 8))
        else:
            text = prose(rng, rng.randint(20, 120)) + " " + base[5][: rng.randint(0, 300)]
        lang = ["en", "fr"][i % 2]
        rows.append((i, text + (" é" * 5 if lang == "fr" else ""), lang, f"src{i % 7 if i % 3 else 0}", len(text), float(i), "x"))
    rows += [
        (200, None, None, None, None, None, None),
        (201, "", "en", "src1", 0, 1.0, "x"),
        (202, " \n\t ", None, "src1", 4, 1.0, "x"),
        (203, "12 34 --", "fr", None, 8, 1.0, "x"),
        (204, "word", "en", "src2", 4, 1.0, "x"),
        (205, "a" * 3000, "en", "web", 3000, 1.0, "x"),
        (206, prose(rng, 9000), "en", "src0", 60000, 1.0, "x"),
        (207, "The Of AND to In", "en", "src0", 16, 1.0, "x"),
        (208, "the of and to in", "en", "src0", 16, 1.0, "x"),
        (209, "漢字 かな \u2003 é̀ \U0001f600 İΣς", "fr", "src3", 12, 1.0, "x"),
        (210, base[0], "en", "src9", 1, 1.0, "x"),
        (210, base[0], "en", "src9", 1, 1.0, "x"),
        (None, base[1], "en", "src9", 1, 1.0, "x"),
        (211, "### Assistant: </turn> \\ <|endoftext|>", "en", "src9", 1, 1.0, "x"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def distinct_docs(spark, docs):
    """Without a null or repeated id, for comparisons that need ids."""
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def sf(spark, distinct_docs, tmp_path_factory):
    """A folder of small tables."""
    path = str(tmp_path_factory.mktemp("sf"))
    distinct_docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 1 if "stupid" in (t or "") else 0) for i, t, *_ in documents() if i is not None and i % 4 != 3]
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(c, t, ["system", "user", "assistant"][t % 3], f"### say {c} \\ {t} </turn>\\\\### é{'x' * c}") for c in range(12) for t in range(1 + c % 5)]
    turns += [(50, 0, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (51, 0, "User", "capital"), (51, 1, "### odd: </turn>", "role")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path
