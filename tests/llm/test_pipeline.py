"""The whole pipeline against brute force, stage by stage and from end to end."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from palimpsest.llm import line_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
BAD = "blorgy"


def make(rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = prose(15)
    passage = prose(12)
    rows, labels = [], []
    for i in range(240):
        text = prose(40) + "\n" + prose(40)
        if i % 6 == 0:
            text += f"\nyou {BAD} " + prose(3)
        if i % 10 == 1:
            text += "\n" + line
        if i % 40 == 3:
            text += "\n" + prose(5) + " " + passage + " " + prose(5)
        rows.append((i, text))
        labels.append((i, int(i % 6 == 0), 1))
    for i in range(8):  # near copies, in one line each, so that not all of it is a line seen before
        w = rows[7 * i + 1][1].replace("\n", " ").split(" ")
        w[5 + i] = "edited"
        rows.append((300 + i, " ".join(w)))
    rows += [(400, rows[5][1]), (401, rows[5][1]), (402, None), (403, ""), (404, "one"), (404, "one")]
    # judged by their own text: rows without an id, and a clean row that shares its id with a toxic one
    rows += [(None, f"{prose(20)} {BAD}"), (None, f"{prose(9)} {passage} {prose(9)}"), (500, prose(30)), (500, f"{prose(30)} {BAD}")]
    return rows, labels, [(1, passage.upper()), (2, None), (3, prose(30))]


def lower(t):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), t)


def brute_toxic(docs):
    return [(i, t) for i, t in docs if BAD not in (t or "")]


def groups(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(x) for x in range(n)]


def brute_lines(docs):
    normal = lambda x: " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub(r"[0-9]", "0", lower(x))))
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    names = sorted({normal(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    counts = list(map(Counter, names))
    near = []
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            most = int(0.1 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and sum(((counts[i] - counts[j]) | (counts[j] - counts[i])).values()) <= 2 * most:
                if line_dedup.edits(a, b) <= most:
                    near.append((i, j))
    group = dict(zip(names, groups(len(names), near), strict=True))
    first, out = {}, []
    for i, t in docs:
        if t is None:
            out.append((i, t))
            continue
        lines = t.split("\n")
        left = [x for n, x in enumerate(lines) if not normal(x) or first.setdefault(group[normal(x)], (i, n)) == (i, n)]
        if len(left) == len(lines) or "".join(left).strip():
            out.append((i, "\n".join(left)))
    return out


def brute_near(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    group = groups(len(docs), near)
    least = {}
    for (i, _), g in zip(docs, group, strict=True):
        least[g] = min(i, least.get(g, i), key=lambda x: (x is None, x))
    return list(dict.fromkeys(d for d, g in zip(docs, group, strict=True) if d[0] == least[g]))


def brute_clean(docs, benchmark):
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t or ""))
    windows = set()
    for _, x in benchmark:
        w = split(x)
        n = min(10, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
    hit = lambda w: any(tuple(w[s : s + n]) in windows for n in {len(x) for x in windows} for s in range(len(w) - n + 1))
    return [(i, t) for i, t in docs if not hit(split(t))]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows, labels, benchmark = make(random.Random(4))
    d = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, benchmark


def test_pipeline_equals_brute_force(spark, world):
    import base64

    import tiktoken

    d, rows, benchmark = world
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    steps = [brute_toxic(rows)]
    steps.append(brute_lines(steps[-1]))
    steps.append(brute_near(steps[-1]))
    steps.append(brute_clean(steps[-1], benchmark))
    assert [len(rows), *map(len, steps)] == sorted([len(rows), *map(len, steps)], reverse=True) and len(steps[3]) < len(steps[2]) < len(steps[1]) < len(steps[0])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=False):
        out = corpus_pipeline.Scratch(spark, "test").keep(stage(spark, docs, d), name)
        assert out.columns == columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        docs = out
    final = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, d).collect()}
    assert final == {(i, tuple(encoder.encode_ordinary(t or ""))) for i, t in steps[-1]}


def test_pipeline_of_nothing(spark, world, tmp_path):
    d, _, _ = world
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
