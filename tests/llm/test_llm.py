"""Each operator on a small awkward table, against plain brute force, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, fingerprints, kernel, line_dedup, minhash, pii, pretoken, sharding, suffix_dedup, tokenfile, toxicity
from palimpsest.llm.common import Scratch
from palimpsest.llm.components import link_buckets

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, node long, kept string, key string, shard int"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60)
    base = prose(120).split(" ")
    near = [[w if rng.random() > 0.02 else "changed" for w in base] for _ in range(6)]
    out = [None, "", "   \n\n", "one", "two words", prose(4), prose(12000), prose(30) + "\n" + prose(20), "\n".join(["same line here"] * 3)]
    out += [prose(25) + " " + shared + " " + prose(25) for _ in range(3)]
    out += [" ".join(base), *map(" ".join, near), " ".join(base), " ".join(base).upper()]
    out += ["mail a.b@x.org, c@d or e@f.gh_i@j.kl now 10.0.0.256 1.2.3.4.5", "card 4111 1111-1111 1111 and 4111111111111112; call +1 (555) 123-4567 or +12"]
    out += ["long line number %d of a text that goes on for quite some words until here it ends\nother" % i for i in (1, 22)]
    out += ["long line number 1 of a text that goes on for quite some words until here it endz\n" + prose(9)]
    return out + ["<|endoftext|> it's 'll a b  　c \U0001f600\U0001f600 d́"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(3, "one"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, None, 7, "x", "k", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture
def empty(docs):
    return docs.where("false")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text, pattern):
    return re.findall(pattern, (text or "").encode())


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def test_op1_repeats_equal_brute_force(docs, rows, empty):
    found = suffix_dedup.report(suffix_dedup.repeats(docs)).collect()
    where = defaultdict(set)
    split = [words(t, rb"[^\x20\x09-\x0D]+") for _, t in rows]
    for i, w in enumerate(split):
        for s in range(len(w) - 49):
            where[tuple(w[s : s + 50])].add((i, s))
    want = []
    for i, w in enumerate(split):
        hit = set()
        for s in range(len(w) - 49):
            if len(where[tuple(w[s : s + 50])]) > 1:
                hit |= set(range(s, s + 50))
        want.append((rows[i][0], len(w), len(hit)))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.n_words, r.n_repeated) for r in found), key=repr)
    # without the later occurrences each passage is left once
    assert sum(r.n_again for r in found) < sum(r.n_repeated for r in found)
    assert suffix_dedup.report(suffix_dedup.repeats(empty)).count() == 0


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_op2_windows_equal_brute_force(spark, docs, rows, empty, block):
    long = next(t for _, t in rows if t and len(t) > 9999).split(" ")
    items = [(1, " ".join(long[5:40])), (2, "ONE"), (3, None), (4, ""), (5, " ".join(long[100:110])), (5, " ".join(long[100:110])), (10, "two, words"), (7, " ".join(long[200:209]))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    pattern = rb"[0-9a-z\x80-\xff]+"
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    want = []
    for i, t in rows:
        w, hit, names = re.findall(pattern, low(t)), set(), set()
        for name, x in items:
            v = re.findall(pattern, low(x))
            n = min(10, len(v))
            windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names.add(name)
        joined = ",".join(sorted(map(str, names)))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    assert sorted(want, key=repr) == table(decontaminate.report(decontaminate.find(docs, benchmark, block_bytes=block)))
    assert decontaminate.find(empty, benchmark).count() == 0
    assert decontaminate.report(decontaminate.find(docs, benchmark.where("false"))).where("contaminated").count() == 0


def test_op3_shards_are_minimax(docs, rows, empty):
    found = sharding.shard(docs, shards=4).collect()
    groups = {}
    for i, t in by_id(rows):
        groups.setdefault(t, []).append(i)
    order = sorted(groups.items(), key=lambda g: (min([i for i in g[1] if i is not None], default=-1) if any(i is not None for i in g[1]) else -1))
    sizes = [len(ids) * (8 + len((t or "").encode())) for t, ids in order]

    def shards(c):
        n, left = 1, c
        for s in sizes:
            n, left = (n, left - s) if s <= left else (n + 1, c - s)
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 4)
    total, slots, home = defaultdict(int), defaultdict(list), defaultdict(set)
    crc = {zlib.crc32((t or "").encode()) for _, t in rows}
    for r in found:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        home[r.text_crc32, r["size"]].add(r.shard)
    assert len(found) == len(rows) and max(total.values()) == best and {r.text_crc32 for r in found} == crc
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(total) <= set(range(4))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("kind", [tokenfile.BYTE, tokenfile.BIT])
def test_op4_files_round_trip(spark, docs, rows, empty, kind, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    tokenfile.write(docs, str(tmp_path / "f"), JSON, 2, kind)
    found = sorted(tokenfile.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    at = 0
    for (i, t), r in zip(by_id(rows), found, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    tokenfile.write(empty, str(tmp_path / "e"), JSON, 2)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_op4_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000, 5000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        for kind in (tokenfile.BYTE, tokenfile.BIT):
            data = tokenfile.dump(np.array([-5, 9]), np.array([n, 0]), ids, kind, block=777)
            names, sizes, back = tokenfile.load(data)
            assert names.tolist() == [-5, 9] and sizes.tolist() == [n, 0] and back.tolist() == ids.tolist()
            kind_, _, _, blocks = tokenfile.load_index(data)
            if n > 1554:  # a block alone
                assert tokenfile.load_block(data, kind_, blocks[1]).tolist() == ids[777:1554].tolist()
    with pytest.raises(ValueError):
        tokenfile.load(b"nothing of the kind")


def test_op5_learns_and_restores(spark, docs, empty):
    rng = random.Random(2)
    plain = ["garden", "window", "river", "yellow", "morning", "paper", "bridge", "silver"]
    bad = ["blorgy", "snarfed"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        own = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad)] if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic), 1))
    rows += [(1000, "the bl0rgy river"), (1001, "the b l o r g y window"), (1002, "bloooorgy"), (1003, "silver paper"), (1004, None), (1005, ""), (None, "morning")]
    many = spark.createDataFrame([(i, t, 3.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    found = {r.doc_id: r for r in toxicity.score(many, known).collect()}
    assert len(found) == len(rows)
    for i, toxic, _ in labels:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and found[i].predicted == toxic
    assert [found[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 0]
    assert not found[None].held_out and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity.score(empty, known).count() == 0
    assert {r.predicted for r in toxicity.score(docs, known.where("false")).collect()} == {0}


def test_op5_reads_each_mix_of_spacing_signs_and_repeats():
    plain = "the blorgy river was a mörder and the shity garden window bridge morning then there " * 50
    codes = [int(toxicity._CODE[x]) for x in (plain.encode("latin-1"))]
    codes = [0, 0, *[27 if c == "ö" else x for c, x in zip(plain, codes, strict=True)], 0, 0]
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
        counts[((x if y else 0) * toxicity.SYMBOLS + y) * toxicity.SYMBOLS + z] += 1
    read = toxicity.Restorer(toxicity.Model(counts))
    want = {
        "the b l o r g y river": "the blorgy river", "the b l 0 r g y river": "the blorgy river", "b.l-o r_g*y": "blorgy",
        "b l 0 0 0 r 9 y": "blorgy", "s h ! t y": "shity", "bl000rgy": "blorgy", "bloooorgy": "blorgy", "blorgy!": "blorgy!", "blorgy!!": "blorgy!!",
        "mörd3r": "mörder", "m ö r d 3 r": "mörder", "möööörder": "mörder", "blorgyyyyyyyyyyyyyyyyyyyyyyyyyyyyy0": None,
    }
    got = {x: read(x) for x in want}
    assert {x: got[x] for x, y in want.items() if y} == {x: y for x, y in want.items() if y}
    assert len(got["blorgyyyyyyyyyyyyyyyyyyyyyyyyyyyyy0"]) < 12
    for x in ("b l 0 r g y", "m ö 3"):
        data = np.frombuffer(x.encode(), np.uint8)
        assert toxicity.suspicious(data, np.array([0, len(data)])).tolist() == [0]


def test_op6_base_spans_and_disclosure(spark, docs, rows, empty):
    line = "write to zorgon@mail.example please quixotic"
    extra = [(900 + i, f"{line} tail{i}\nplease write") for i in range(3)] + [(950 + i, "please write to tail") for i in range(40)]
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = defaultdict(list)
    for r in pii.report(pii.detect(many)).collect():
        found[r.doc_id].append(r)

    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for i, t in [*rows, *extra]:
        base = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() in {r.base_sha256 for r in found[i]}
        assert any([x for x in r.spans.split(",") if x and not x.startswith("term")] == base for r in found[i])
    # what only goes with the address gives it away, what is said everywhere does not
    at = line.index("quixotic")
    assert found[900][0].spans == f"email:9:28,term:{at}:{at + 8}"
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.detect(many)).collect()}
    assert clean[901] == "write to [email] please  tail1\nplease write"
    assert pii.report(pii.detect(empty)).count() == 0


def test_op6_judges_words_of_entities_seen_once(spark):
    rows = [(0, "ask vexilla at once@mail.example about garden"), (1, "\n".join(["ask about garden at noon"] * 3000))]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.term for r in pii.detect(many).collect()}
    assert [s.value for s in found[0]] == ["vexilla"] and found[1] == []


def test_op7_equals_the_library(docs, rows, empty):
    import tiktoken

    vocabulary, encoder, _, _ = bpe.tools(RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(want, key=repr) == table(bpe.round_trip(docs, RANKS))
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back.collect() if r.doc_id is not None) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    assert bpe.round_trip(empty, RANKS).count() == 0
    rng = random.Random(9)
    some = ["".join(rng.choice("ab'sS llre\n\t　é1²٣中😀.,-_<|>") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for _, _, data, offsets in kernel.slices(pa.array(some)):
        ids, at = encoder(data, offsets)
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [plain.encode_ordinary(t) for t in some]
    # a prefix's table holds for all that is appended to it
    whole = vocabulary.last(b"unbelievably", [], 0)
    assert vocabulary.last(b"unbelievably", vocabulary.last(b"unbel", [], 0), 5) == whole
    assert pretoken.CACHE > 0


def test_pretokens_met_again_outlast_a_full_cache(monkeypatch):
    monkeypatch.setattr(pretoken, "CACHE", 40)
    met = []

    def encode(tokens):
        met.extend(tokens)
        return pretoken.joined([list(t) for t in tokens])

    encoder = pretoken.Encoder(encode)
    for i in range(200):
        text = " often again" + "".join(f" x{chr(0x4E00 + 20 * i + j)}" for j in range(20))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, bounds = encoder(data, np.array([0, len(data)]))
        assert bytes(ids.tolist()) == text.encode() and bounds.tolist() == [0, len(data)]
    assert met.count(b" often") == met.count(b" again") == 1 and len(met) == 2 + 20 * 200


def test_op4_pieces_equal_single_texts():
    encoder = tokenfile.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    tokens = ["".join(rng.choice("aé 日x'1<|>") for _ in range(rng.randrange(1, 9))).encode() for _ in range(1000)]
    ids, sizes = encoder._pieces(tokens)
    want = [x.ids for x in encoder._batch([t.decode() for t in tokens])]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [x.tolist() for x in encoder._pieces([])] == [[], []]


def test_op8_lines_equal_brute_force(docs, rows, empty):
    unique = {(i, t): None for i, t in by_id(rows)}
    lines, first, order = [], {}, [k for k in unique]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    normal = lambda x: b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), re.sub(rb"[0-9]", b"0", x.encode())))).decode()
    for d, (_, t) in enumerate(order):
        lines += [(d, n, normal(x)) for n, x in enumerate((t or "").split("\n"))]
    names = sorted({x for _, _, x in lines if x})
    group = {x: x for x in names}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for i, a in enumerate(names):
        for j in range(i):
            b, top = names[j], max(len(a), len(names[j]))
            if min(len(a), len(b)) >= 0.9 * top and distance(a, b) <= int(0.1 * top + 1e-9):
                assert line_dedup.edits(a, b) == distance(a, b)
                group[root(a)] = root(b)
    gone = defaultdict(list)
    for d, n, x in lines:
        if x and first.setdefault(root(x), (d, n)) != (d, n):
            gone[d].append(n)
    want = {}
    for d, (i, t) in enumerate(order):
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in gone[d]]
        want[i, hashlib.sha256("\n".join(left).encode()).hexdigest()] = ",".join(map(str, gone[d]))
    found = {(r.doc_id, r.text_sha256): r.removed for r in line_dedup.report(docs).collect()}
    # a null id has two texts here, whose order among themselves is by a hash
    assert {k: v for k, v in found.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    clashing = docs.withColumns({x: F.lit(1) for x in ("__key", "numbers", "row", "gone_id", "a`b")})
    assert line_dedup.deduplicate(clashing).columns == [*clashing.columns, "removed_lines"]
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == [*docs.columns, "removed_lines"] and kept.count() == docs.count()
    assert line_dedup.deduplicate(empty).count() == 0


def test_op8_finds_lines_with_an_edited_word(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwyé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    first, again = [], []
    for n in (4, 8, 12, 16, 20, 30, 60):
        for _ in range(40):
            line = [rng.choice(words) for _ in range(n)]
            most = len(" ".join(line)) // 10
            at = rng.choice([i for i, w in enumerate(line) if len(w) <= most] or [0])
            other = line[:at] + ["".join(rng.choice("xqz") for _ in line[at][:most]) + line[at][most:]] + line[at + 1 :]
            first.append(" ".join(line))
            again.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(first + again)] + [(1000, "")]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    removed = {r.doc_id for r in line_dedup.report(many).collect() if r.n_removed}
    assert removed <= set(range(len(first), 2 * len(first))) and len(removed) >= 0.97 * len(first)
    data = "\n".join(first).encode()
    lines = line_dedup.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    flat, at = lines.normal
    assert [flat[x:y].tobytes().decode() for x, y in zip(at[:-1], at[1:], strict=True)] == first
    for n in (first[0], " ".join(first[-9:])):  # more than 255 words too
        lines = line_dedup.Lines(np.frombuffer(n.encode(), np.uint8), np.array([0, len(n.encode())]))
        bits = np.unpackbits(lines.words.hash.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        assert np.packbits(2 * bits.sum(0) > len(bits)).view(np.uint64)[0] == lines.simhash()[0, 0]


def test_op8_parities_lose_no_link():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 4))) for _ in range(40)] + ["né", "日本"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for x in lines[:200]:
        at = [rng.randrange(len(x)) for _ in range(rng.randrange(len(x) // 10 + 1))]
        lines.append("".join(rng.choice(("", "é", "q", "zz")) if i in at else c for i, c in enumerate(x)))
    data = "\n".join(lines).encode()
    made = line_dedup.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    flat, at = made.normal
    names = [flat[x:y].tobytes().decode() for x, y in zip(at[:-1], at[1:], strict=True)]
    bits = np.unpackbits(made.parity().view(np.uint8), axis=1).astype(int)
    apart = lambda i, j: int((bits[i] != bits[j]).sum())
    for i, x in enumerate(names):
        for j in range(i):
            if max(len(x), len(names[j])) <= line_dedup.EVEN and (i - 300 == j or rng.random() < 0.05):
                assert apart(i, j) <= 4 * line_dedup.edits(x, names[j])


def test_op8_lines_that_meet_by_chance_are_no_candidates(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    met, confirm = [], line_dedup.confirm
    monkeypatch.setattr(line_dedup, "confirm", lambda pairs: met.append(pairs.count()) or confirm(pairs))
    short = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    line_dedup.report(docs).collect()
    assert sum(met) < 1500, met


@pytest.mark.parametrize(("few", "rounds"), [(0, 1), (0, 2), (8, 2)])
def test_buckets_lose_no_link(spark, few, rounds):
    # the first centre is far from both others, and so is each later centre but 2 or 3
    scratch = Scratch(spark, "test")
    nodes = spark.createDataFrame([(n, 0, (x,)) for n, x in ((1, 0), (2, 50), (3, 51))], "node long, rank int, x struct<v:int>")
    near = lambda x, y: f"abs({x}.v - {y}.v) <= 1"

    def deal(step, component, rest):
        if component is None:
            return nodes.selectExpr("7L as bucket", "node", "node as c")
        return nodes.join(component, "node", "left").selectExpr("7L as bucket", "node", "coalesce(component, node) as c")

    found = link_buckets(deal, nodes, near, lambda pairs, _: pairs, scratch, rounds=rounds, few=few)
    assert {(r.node, r.component) for r in found.collect()} == {(2, 2), (3, 2)}


def test_buckets_of_scattered_links_make_few_pairs(spark):
    # any two of 240 are linked with a chance of 0.08, but for 20 that are alone
    scratch, met, size = Scratch(spark, "test"), [], 240
    nodes = spark.range(size).selectExpr("id as node", "0 as rank", "struct(id as v) as x")

    def deal(step, component, rest):
        rows = nodes.selectExpr("explode(array(7L, 8L)) as bucket", "node", "node as c")
        return rows if component is None else rows.drop("c").join(component, "node", "left").selectExpr("bucket", "node", "coalesce(component, node) as c")

    def verify(pairs, _):
        met.append(pairs.collect())
        return pairs.where("least(a, b) >= 20 and pmod(xxhash64(least(a, b), greatest(a, b)), 100) < 8")

    found = {r.node: r.component for r in link_buckets(deal, nodes, lambda x, y: "true", verify, scratch, rounds=2, centres=16).collect()}
    assert found == dict.fromkeys(range(20, size), 20)
    assert sum(map(len, met)) < 0.7 * size * (size - 1) / 2
    _, wide, last = map(set, met)
    assert len(wide & last) < size  # of the centre by the least hash only


def test_op8_edits_stop_at_the_most():
    rng = random.Random(2)
    for _ in range(2000):
        x = "".join(rng.choice("abé") for _ in range(rng.randrange(30)))
        y = "".join(rng.choice("abé") if rng.random() < 0.2 else c for c in x)[rng.randrange(3) :]
        full, most = line_dedup.edits(x, y), rng.randrange(8)
        found = line_dedup.edits(x, y, most)
        assert found == full if full <= most else found > most


def test_op9_components_equal_brute_force(docs, rows, empty):
    sets = []
    for _, t in rows:
        w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""), rb"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)].append(d)
    want = []
    for i, (d, _) in enumerate(rows):
        c = min(names[root(i)], default=None)
        want.append((d, len(sets[i]), c, c is None or d == c))
    assert sorted(want, key=repr) == table(minhash.near_duplicates(docs))
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.least_matches(0.75)[-1] < 150 and 38 < minhash.most_unequal(0.75) < 75


def test_op9_links_through_repeated_and_null_ids(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    edit = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    a, bridge, far, other = edit(), edit(10), edit(10, 50), " ".join(reversed(base))
    # 1 and 2 by (2, A') though id 1 has another text too; 4 and 5 only by a text without an id
    rows = [(1, a), (2, bridge), (1, other), (4, a + " one two"), (None, bridge), (9, far), (None, "alone"), (None, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=repr)
    want = [(1, 96, 1, True), (1, 96, 1, True), (2, 96, 1, False), (4, 98, 1, False), (9, 96, 1, False)]
    want += [(None, 0, None, True), (None, 1, None, True), (None, 96, 1, False)]
    assert got == sorted(want, key=repr)


def test_op9_prefixes_equal_all_pairs(spark, tmp_path):
    """A bucket without links in its star rounds: the join on prefixes finds the pairs that brute force finds."""
    rng = random.Random(6)
    passages = [[f"p{i}w{j}" for j in range(30)] for i in range(12)]
    rows = []
    for i in range(120):
        own = [f"d{i}w{j}" for j in range(rng.choice([5, 20, 60]))]
        rows.append((i, " ".join(w for p in rng.sample(passages, 3) for w in p) + " " + " ".join(own)))
    sets = [{tuple(t.split()[s : s + 5]) for s in range(len(t.split()) - 4)} for _, t in rows]
    links = {(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(rows, "node long, text string")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, n long")
    own = minhash.prefixes(texts, sizes, 75, Scratch(spark, "test")).collect()
    by = defaultdict(list)
    for r in own:
        by[r.shingle].append((r.node, r.at, len(sets[r.node])))
    first = lambda i, n, j, m: 175 * (1 + min(n - i, m - j)) >= 75 * (n + m)
    met = {(max(a, b), min(a, b)) for x in by.values() for a, i, n in x for b, j, m in x if a != b and first(i, n, j, m)}
    assert links and links <= met and len(met) < 120 * 119 / 4
    many = spark.createDataFrame(rows, "doc_id long, text string")
    group = list(range(120))
    for _ in range(120):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(many).collect()} == dict(enumerate(group))


def test_op10_equals_brute_force(docs, rows, empty):
    import xxhash

    def spark_hash(*values):
        seed = 42
        for x in values:
            data = x.encode() if isinstance(x, str) else (x[0].to_bytes(4, "little", signed=True) if isinstance(x, tuple) else x.to_bytes(8, "little", signed=True))
            seed = xxhash.xxh64_intdigest(data, seed)
            value, seed = seed - (seed >> 63 << 64), seed
        return value

    def fingerprint(t):
        h = [spark_hash(w) for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
        if len(h) < 4:
            return [(0, spark_hash(*h))] if h else []
        return [(i, spark_hash(*h[i : i + 4])) for i in range(len(h) - 3) if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2])]

    def neighbours(a):
        return {spark_hash(a[0][1])} if len(a) == 1 else {spark_hash(x, y, (j - i,)) for (i, x), (j, y) in zip(a, a[1:], strict=False)}

    def like(a, b):
        a, b = neighbours(a), neighbours(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    shown = lambda a: ",".join(f"{i}:{h & 0xFFFFFFFFFFFFFFFF:x}" for i, h in a)
    order, want = by_id(rows), []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(a, b), like(a, c)))
    for ranges in (3, None):
        assert sorted(want, key=repr) == table(fingerprints.compare_edited(docs, ranges=ranges))
    assert fingerprints.compare_edited(empty).count() == 0
    # passages in another order match but where they meet; the same words in another order do not
    text = " ".join(f"w{i}" for i in range(400))
    moved = " ".join(f"w{i}" for i in [*range(200, 400), *range(200)])
    assert 0.95 < like(fingerprint(text), fingerprint(moved)) < 1 and like(fingerprint(text), fingerprint(" ".join(reversed(text.split())))) == 0
