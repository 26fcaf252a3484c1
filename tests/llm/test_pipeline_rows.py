"""The whole pipeline against brute force, stage by stage, over null and repeated ids and clashing columns."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_models import brute_groups
from tests.llm.test_whole_queries import brute_toxicity, toxic_rows
from verisift.llm import mixing, quality
from verisift.llm.tokens import TokenIds, default_tokenizer

SCHEMA = pa.schema({"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "_id": pa.int64(), "k1": pa.string(), "_row": pa.int64(), "n": pa.float64()})


def rows_and_labels(seed):
    rows, labels = toxic_rows(seed)
    r = random.Random(seed)
    near = [(500 + i, " ".join([*rows[1][1].split(), *[f"near{j}" for j in range(60)], f"end{i}"])) for i in range(12)]
    far = [(600 + i, " ".join(f"u{r.randrange(900)}" for _ in range(r.choice([6, 30, 1500])))) for i in range(40)]
    loose = [(None, f"a document without an id that has words enough to stay number {i}") for i in range(2)]
    rows = [*rows, *near, *near[:2], *far, *loose, loose[0], (610, "another text of ten words under an id that is taken")]
    return [(i, t, r.choice(["en", "en", None]), r.choice(["a", "a", "b", None])) for i, t in rows], labels


def write(folder, rows, labels):
    cols = list(zip(*[(*x, k, "c", -k, 0.5) for k, x in enumerate(rows)], strict=True)) if rows else [[] for _ in SCHEMA]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA), folder / "documents.parquet")
    marks = pa.table({"doc_id": pa.array([*labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int64()), "toxic": pa.array([*labels.values()], pa.int64())})
    pq.write_table(marks, folder / "labels.parquet")


def sql(rows, text):
    """Rows of a query of the operators over (doc_id, text, lang, source) rows, each under its number as doc_id."""
    con = duckdb.connect()
    t = lambda k: pa.array([x[k] for x in rows], pa.string())
    con.register("documents", pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": t(1), "lang": t(2), "source": t(3)}))
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    return {x["doc_id"]: x for x in (dict(zip(names, v, strict=True)) for v in cur.fetchall())}


def test_pipeline_whole(spark, tmp_path):
    rows, labels = rows_and_labels(5)
    write(tmp_path, rows, labels)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = lambda df: Counter(tuple(x) for x in df.select("doc_id", "text", "lang", "source").collect())
    stages = dict(corpus_pipeline.STAGES)

    def step(name, kept):
        out = corpus_pipeline.staged(stages[name](spark, kept, str(tmp_path)), "test")
        assert out.columns == given.columns
        return out

    judged = brute_toxicity([x[:2] for x in rows], labels)
    rows = [x for x, (score, *_) in zip(rows, judged, strict=True) if score < 0.5]
    kept = step("toxicity", given)
    assert whole(kept) == Counter(rows) and len(rows) < len(judged)

    verdict = sql(rows, quality.SQL)
    rows = [x for k, x in enumerate(rows) if verdict[k]["kept"]]
    kept = step("quality_rules", kept)
    assert whole(kept) == Counter(rows) and {x[0] for x in rows} >= {None, 610}

    # Null ids come last, so that the least row of each group stays; rows of one text and id are one.
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    groups = {d: c for d, _, c in brute_groups([(k, x[1]) for k, x in enumerate(rows)])}
    kept = step("ngram_jaccard", kept)
    assert len(set(groups.values())) == kept.count() < len(rows)
    left = whole(kept)
    assert left.keys() <= set(rows)
    assert sorted(Counter((groups[rows.index(x)]) for x in left.elements()).values()) == [1] * len(set(groups.values()))
    ids = lambda xs: Counter(x[0] for x in xs)
    assert ids(left.elements()) == ids(rows[c] for c in set(groups.values()))

    # The mix's own draw goes by doc_id, so its SQL runs on the rows under their own ids.
    rows = list(left.elements())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{kept.staged_path}/*.parquet')")
    taken = Counter()
    for d, size, _, _, t in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall():
        taken[d] += t // size if size else 0
    kept = step("source_mix", kept)
    mixed = whole(kept)
    assert mixed.keys() <= left.keys() and ids(mixed.elements()) == +taken and max(mixed.values()) == 2

    tok = TokenIds(default_tokenizer(), 2).library
    want = Counter()
    for (d, t, *_), n in mixed.items():
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(x) - 1) % 1024 + 1, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[d, k, a, b - a, zlib.crc32(x[a:b].tobytes())] += n
    packed = stages["packing"](spark, kept, str(tmp_path)).toPandas()
    got = Counter((None if p.doc_id != p.doc_id else int(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in packed.itertuples())
    assert got == want and any(k[1] for k in want)
    for _, p in packed.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.offset.tolist() == [0, *p.length.cumsum()[:-1]] and p.length.sum() <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    write(tmp_path, [], {})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    bare = docs(spark, [(None, None, None, None), (1, "", None, "a")])
    left = corpus_pipeline.toxic(spark, bare, str(tmp_path))
    assert left.count() == 2 and corpus_pipeline.rules(spark, left, str(tmp_path)).count() == 0
