"""The SQL of the queries against the queries themselves, on small tables with odd rows."""

import random

import duckdb
import numpy as np
import pytest

from tracelens.llm import queries


def rows(frame):
    return sorted(map(repr, (tuple(None if v is None else v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False))))


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op6_quality_rules", "op10_minhash"])
def test_sql_gives_the_same(spark, tmp_path, name):
    rng = random.Random(17)
    lines = ["Home | About | Help", "ALL IN CAPITALS HERE", "Read more", "it goes on and on with no end mark whatever and so on and so on", "The cat sat, then it left.", "### $$$ %% x", "", " \t", "Tous droits réservés", "é É | x | y"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(40)]
    base = [f"w{rng.randrange(200)}" for _ in range(50)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(50)] = f"x{rng.randrange(200)}"
        texts.append(" ".join(w) + rng.choice(["", ".", "\n" + lines[0]]))
    texts += [None, "", "a", "A", "a b", texts[50], texts[50].upper()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    g = np.random.default_rng(3)
    centers = g.standard_normal((4, 8))
    vectors = [(centers[i % 4] + g.standard_normal(8) * g.choice([0.05, 0.3])).astype(np.float32).tolist() for i in range(80)]
    vectors += [vectors[0], None, [0.0] * 8, [float("nan")] * 8, [1.0, None], [], [1.0, 0.0]]
    spark.createDataFrame([(i, v, None if i == 5 else i % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert rows(got) == rows(want) and len(got) > 80
