"""Prefix trie, disclosure and hard negatives against plain forms, on small tables with every odd row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mixhaz.llm.radix_tree import SIZES, RadixTree

# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, id long"


def conversations(spark, rows, parts=3):
    rows = [(*r, 1, "x", 5) for r in rows]
    return spark.createDataFrame(rows, TURNS).repartition(parts) if rows else spark.createDataFrame([], TURNS)


def turn_id(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, turn_id(role, text), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:] if rebuild else mine
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1] if path else "")
    ends = defaultdict(list)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, who in members.items()), key=repr)


def some_turns(seed=3, n=160):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, n), 300, 301, 399, 10**12 + 7]:
        if c % 17 == 5:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 5, 9]) if c % 100 else 4):
            text = rng.choice(["hi", "what?", "é" * 3, "tell me more", ""]) if rng.random() < 0.8 else None
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), text))
    rows += [(700 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]      # a group of copies
    rows += [(800 + i, t, "user", f"same {t}" if t < 2 else str(i)) for i in range(30) for t in range(4)]  # a common beginning
    rows += [(900, 1, "user", "twice"), (900, 1, "user", "twice"), (900, 1, "user", "tie"), (None, 0, "user", "nobody"), (901, None, None, None)]
    rows += [(902, t, "user", "z" * 40_000 if t == 2 else f"turn {t}") for t in range(400)]  # long in turns and in text
    return rows


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


@pytest.mark.parametrize("batch, parts, rebuild", [(1, 7, True), (3, 2, True), (50_000, 5, True), (2, 40, False)])
def test_trie(spark, batch, parts, rebuild):
    from mixhaz.llm.prefix_trie import packed, prefix_trie, with_shared_heads

    rows = some_turns()
    turns = packed(conversations(spark, rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that seams lie between many tasks
    try:
        got = prefix_trie(with_shared_heads(turns) if rebuild else turns, batch).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows, rebuild)


def test_trie_texts_and_empty(spark):
    from mixhaz.llm.prefix_trie import packed, prefix_trie, with_shared_heads, with_texts

    assert prefix_trie(with_shared_heads(packed(conversations(spark, [])))).count() == 0
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (2, 1, "user", None)]
    table = conversations(spark, rows)
    got = with_texts(prefix_trie(packed(table)), table).collect()
    assert sorted(((r["depth"], r["role"], r["text"], r["n_convs"]) for r in got), key=repr) == [
        (0, None, None, 2), (1, "user", "a", 2), (2, "", "b", 1), (2, "user", "", 1)]


def test_pieces_of_a_long_list(spark, monkeypatch):
    from mixhaz.llm import prefix_trie as module

    monkeypatch.setattr(module, "PIECE", 3)
    rows = [(i, 0, "user", "all") for i in range(50)] + [(60, 0, "user", "one")]
    got = module.prefix_trie(module.packed(conversations(spark, rows))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows, False)


def test_radix_tree_layouts():
    """Nodes grow through all layouts and shrink back; values and counts are those of a dictionary."""
    tree, seen = RadixTree(), set()
    for a in range(256):
        tree.insert(bytes([7, a, a % 3, 9]), 1, a, (), a)
        seen.add(tree.root.child(7).level)
    assert seen >= {-1, 0, 1, 2, 3} and len(tree.root.child(7).branch) == 256 and tree.root.n == 256
    node, levels = tree.root.child(7), set()
    for x in node.children()[:-1]:
        node.drop(x)
        levels.add(node.level)
        assert len(node.branch) <= SIZES[node.level]
    assert levels == {0, 1, 2, 3}
    rng = random.Random(5)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(300)})
    tree = RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, 1, i, (), i + 1)

    def walk(node, prefix):
        prefix += node.label
        if node.value is not None:
            yield prefix, node.value
        for x in node.children():
            yield from walk(x, prefix)

    assert dict(walk(tree.root, b"")) == {k: i + 1 for i, k in enumerate(keys)}


# ---------------------------------------------------------------- disclosure

DOCS = "doc_id long, text string, lang string, key long, spans string, term int"


def documents(spark, rows, parts=3):
    rows = [(i, t, "en", 3, "x", 1) for i, t in rows]
    return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and not all(int(p) <= 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            value = m.group().lower() if name == "email" else ".".join(str(int(p)) for p in m.group().split(".")) if name == "ip" else digits
            out.append((m.start(), kind, m.end(), (kind, value)))
    return sorted(out)


def plain_terms(rows, near, alpha, support):
    """Words and forms that give an entity away, counted plainly."""
    form = lambda w: "".join("0" if b in b"0123456789" else "x" for b in w.encode())
    docs = []
    for _, text in rows:
        text = text or ""
        base = plain_base(text)
        words = [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x.group().lower(), m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        free = [w for w in words if not any(a < w[1] and b > w[0] for a, _, b, _ in base)]
        pairs = set()
        for a, _, b, entity in base:
            left, right = [w for w in free if w[0] < a][-near:], [w for w in free if w[0] >= b][:near]
            pairs |= {(entity, t) for w in left + right for t in (("w", w[2]), ("f", form(w[2])))}
        docs.append((text, {e for *_, e in base}, pairs, {t for w in words for t in (("w", w[2]), ("f", form(w[2])))}, free, base))
    df_t, df_e, both, texts = Counter(), Counter(), Counter(), defaultdict(set)
    for text, entities, pairs, terms, _, _ in docs:
        df_t.update(terms)
        df_e.update(entities)
        both.update(pairs)
        for p in pairs:
            texts[p].add(text)
    n, found = len(docs), set()
    for (e, t), together in both.items():
        if len(texts[e, t]) >= support and df_e[e] < n and 1 - math.log(df_t[t] / together) / math.log(n / df_e[e]) >= alpha - 1e-12:
            found.add(t)
    out = []
    for (_, text), (_, _, _, _, free, base) in zip(rows, docs):
        spans = [(a, k, b, f"[{('email', 'ip', 'card', 'phone')[k]}]") for a, k, b, _ in base]
        spans += [(a, 4, b, "[removed]" if ("f", form(w)) in found else form(w)) for a, b, w in free if ("w", w) in found]
        out.append(sorted(spans))
    return out


def private_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoéß") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(60):
        text = prose(rng.randint(0, 30))
        if i % 4 == 0:
            text += f" Zacharias wrote to zach.{i % 8}@mail.example.org from 10.0.{i % 8}.255, account K-{i % 8}77 " + prose(12)
        if i % 5 == 0:
            text += " pay 4111 1111-1111 1111 or call +49 (30) 1234-5678 today " + prose(5)
        rows.append((i, text))
    rows += [(100, "Zacharias was here"), (101, None), (102, ""), (103, "a@b.c.d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3"), (103, "another text"),
             (104, "4" * 30_000), (105, "x" * 30_000 + "@y.z"), (106, "ü@ü.de +1 " + "." * 3000 + " 5 +123456789012345 +1-2"), (107, "a@b..c a@-.- +1(234)567-8901"),
             (None, rows[0][1]), (8, rows[8][1]), (8, rows[8][1]), (108, "9" * 400 + ".1.1.1 5555 5555 5555 4444 5"), (109, prose(9000) + " zach.0@mail.example.org")]
    return rows


@pytest.mark.parametrize("near, alpha, support", [(8, 0.9, 3), (3, 0.5, 2), (8, 0.2, 1)])
def test_disclosure(spark, near, alpha, support):
    from mixhaz.llm.disclosure import private_spans

    rows = private_rows()
    got = private_spans(documents(spark, rows), near, alpha, support).collect()
    want = plain_terms(rows, near, alpha, support)
    assert any(s[1] == 4 for w in want for s in w)
    found = sorted(((r["doc_id"], [(s["start"], s["kind"], s["stop"], s["by"]) for s in r["spans"]]) for r in got), key=repr)
    assert found == sorted(((i, w) for (i, _), w in zip(rows, want)), key=repr)


def test_sanitised_and_empty(spark):
    from mixhaz.llm.disclosure import private_spans, sanitised

    rows = private_rows()
    table = documents(spark, rows)
    got = sanitised(table, alpha=0.5, support=2)
    assert got.columns == table.columns
    assert sorted(((r["doc_id"], r["text"] is None) for r in got.collect()), key=repr) == sorted(((i, t is None) for i, t in rows), key=repr)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert "@" not in text[4] and "[email]" in text[4] and "zacharias" not in text[4].lower() and "zacharias" not in text[100].lower()
    assert text[102] == "" and private_spans(documents(spark, [])).count() == 0
    assert sanitised(documents(spark, [])).count() == 0


def test_private_data_query(spark, tmp_path):
    from mixhaz.llm.disclosure import op12_private_data

    rows = private_rows()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_private_data(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        base = sorted(plain_base(text))
        kinds = [s[1] for s in base]
        listed = ",".join(f"{PATTERNS[s[1]][0]}:{s[0]}:{s[2]}" for s in base)
        want.append((i, *(kinds.count(k) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    found = [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(sum(w[k] for w in want) for k in range(1, 5))
    assert all(r["n_term"] == r["spans"].count("term:") for r in got)


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank int, q string, anchor long"


def vectors(spark, rows, parts=3):
    rows = [(i, v, c, 1, "x", 3) for i, v, c in rows]
    return spark.createDataFrame(rows, VECTORS).repartition(parts) if rows else spark.createDataFrame([], VECTORS)


def plain_negatives(rows, modulus):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if None not in (i, v, c) and not any(x is None or not math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in kept if i % modulus == 0}:
        scored = sorted(((-dot(v, w), j, d) for j, w, d in kept))
        for s, j, d in [x for x in scored if x[2] == c and x[1] != i][:5]:
            fit = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def vector_rows(n=300, size=6, scale=0.4):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, size) + 0.3], int(rng.integers(0, 4))) for i in range(n)]
    rows[12] = (12, None, 1)
    rows[20] = (20, [0.1] * (size - 1) + [None], 1)
    rows[30] = (30, [0.1] * (size - 1) + [float("nan")], 1)
    rows[40] = (40, [float("inf")] * size, 1)
    rows[50] = (50, rows[50][1], None)
    return [*rows, (None, [1.0] * size, 2), rows[60], (60, rows[61][1], 3), rows[70], rows[70], (1001, [0.5], 0), (1010, [], 1), (-10, rows[5][1], 2)]


@pytest.mark.parametrize("block, tile", [(16_384, 1024), (4, 7)])
def test_negatives(spark, monkeypatch, block, tile):
    from mixhaz.llm import residue_search as module

    monkeypatch.setattr(module, "TILE_ROWS", tile)
    monkeypatch.setattr(module, "TILE_ANCHORS", 3 if tile < 10 else tile)
    rows = vector_rows()
    table = module.prepared(vectors(spark, rows))
    got = module.hard_negatives(table, table.filter("vec_id % 10 = 0"), block=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_negatives_without_rows(spark):
    from mixhaz.llm.residue_search import hard_negatives, prepared

    table = prepared(vectors(spark, []))
    assert hard_negatives(table, table).count() == 0
    table = prepared(vectors(spark, vector_rows()))
    assert hard_negatives(table, table.filter("vec_id = -1")).count() == 0
    one = prepared(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]))
    assert hard_negatives(one, one).count() == 0


@pytest.mark.parametrize("size, most", [(3, 10), (64, 1 << 12), (700, 300), (1, 1 << 24), (0, 5)])
def test_residue_products_are_exact(size, most):
    from mixhaz.llm.residue_search import Scorer

    rng = np.random.default_rng(size)
    a, b = rng.integers(-most, most + 1, (9, size)), rng.integers(-most, most + 1, (5, size))
    bound = int(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()))
    assert (Scorer(b, bound).scores(a, 0, 5) == a @ b.T).all()
