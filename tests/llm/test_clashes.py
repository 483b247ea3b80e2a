"""Extra columns of any name pass through or are ignored: results do not change."""

import random

import pytest
from pyspark.sql import functions as F

from shoal.llm import exact, lines, mixing, near, passages, queries, simhash, toxicity
from tests.llm.test_operators import frame, words_like

#: Names that operators use inside, old ones of theirs, and those of their results.
NAMES = """key _key KEYS number _number score row what done n_lines n_removed take plan here fp node root digest keep_id bucket skey size h
pos copies part taken block blocks ends shard other hub other_id at id gone keeper first times kind rows words same best late found toxic path host
rule verdict n k rules met suffix domain page_id payload payload_bytes record_type refers_to fine coarse start within weight total target seats
__at __row __chunks __text __lines __gone __score __copies __part __size __take __id __md5 __key __first __source member ids places fingerprint a b x
token component_id keep group_size kept held_out predicted label labels copy place html url good good_mean""".split()


def widened(df, key):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.concat(F.lit(c + "-"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias(c) for c in dict.fromkeys(NAMES) if c.lower() not in taken])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(51)
    texts = ["\n".join(words_like(rng, 8) for _ in range(rng.randrange(1, 12))) for _ in range(24)]
    texts += [texts[0], texts[1] + " x", texts[2] + "\n" + texts[3] + "\n" + texts[4], None, ""]
    ids = [*range(26), 25, None, 27]
    base = frame(spark, texts, ids, [rng.choice("abc") for _ in texts]).select("doc_id", "text", "lang", "source", "n_chars")
    return base, widened(base, "doc_id")


@pytest.fixture(scope="module")
def marks(spark):
    rows = spark.createDataFrame([(i, i % 3 > 0, int(i % 5 == 0)) for i in range(27)], "doc_id long, quality boolean, toxic int")
    return rows.withColumn("quality", F.col("quality").cast("int"))


def seen(df, columns):
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("apply", [
    lambda d, m: lines.without_repeats(d), lambda d, m: passages.without_passages(d), lambda d, m: exact.survivors(d), lambda d, m: near.keep_one(d),
    lambda d, m: simhash.keep_one(d), lambda d, m: mixing.mixed(d), lambda d, m: toxicity.clean(d, m),
], ids=["lines", "passages", "exact", "near", "simhash", "mixing", "toxicity"])
def test_columns_pass_through(docs, marks, apply):
    plain, wide = docs
    out = apply(wide, marks)
    assert out.columns[: len(wide.columns)] == wide.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert seen(out, plain.columns) == seen(apply(plain, marks), plain.columns)
    for r in out.collect():
        assert all(r[c] == f"{c}-{'null' if r.doc_id is None else r.doc_id}" for c in wide.columns[len(plain.columns) :])


def test_shard_beside_a_column_of_that_name(docs):
    out = mixing.mixed(docs[1], shard="to")
    assert out.columns == [*docs[1].columns, "to"]


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith("op")])
def test_queries_ignore_other_columns(spark, docs, marks, tmp_path, name):
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.org/{i}", "<p>" * (i * 40)) for i in range(12)] + [(None, None, None)], "page_id long, url string, html string")
    got = []
    for which, (d, p, m) in enumerate([(docs[0], pages, marks), (docs[1], widened(pages, "page_id"), widened(marks, "doc_id"))]):
        folder = f"{tmp_path}/{which}"
        for table, rows in (("documents", d.filter("doc_id is not null and doc_id != 25")), ("pages", p), ("labels", m)):
            rows.write.parquet(f"{folder}/{table}.parquet")
        out = queries.queries()[name](spark, folder)
        got.append((out.columns, seen(out, out.columns)))
    assert got[0] == got[1] and got[0][1]
