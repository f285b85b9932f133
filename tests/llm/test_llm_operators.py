"""The ten text operators and the pipeline against plain forms, on small tables with every odd row."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score double, n_words int, key string, row int"


def table(spark, docs, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, "en", 0.5, 1, "x", 7) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


PASSAGE = prose(99, 80)
BASE = prose(1, 150)


def changed(text, places):
    w = text.split(" ")
    for p in places:
        w[p] = f"other{p}"
    return " ".join(w)


DOCS = [
    (0, BASE), (1, BASE), (2, changed(BASE, [70])), (3, changed(BASE, [10, 90])), (4, None), (5, ""), (6, "  \n\t "),
    (7, prose(2, 60) + " " + PASSAGE + "\n" + prose(3, 60)), (8, PASSAGE + " " + prose(4, 30)), (9, prose(5, 20) + "\n" + PASSAGE),
    (10, "word " * 300), (11, "Shti " * 150 + prose(6, 40)), (11, "Shti " * 150 + prose(6, 40)), (12, "one two"), (13, "One  TWO"), (14, "é"),
    (15, prose(7, 5000)), (16, "x" * 30000), (None, BASE), (None, prose(8, 50)), (17, prose(7, 5000) + " tail"), (18, prose(9, 300)),
    (19, "MIT License, and the MIT\nlicense; Apache License 2.0. GNU General Public License"), (20, prose(10, 2)),
]


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


class TestContamination:
    ITEMS = [(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (5, prose(9, 12)), (6, PASSAGE), (None, prose(7, 11))]

    def test_brute_force(self, spark):
        from mixhaz.llm.contamination import contamination, without_contaminated

        items = spark.createDataFrame(self.ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS size")
        got = contamination(table(spark, DOCS), items)
        want = brute.contamination(DOCS, self.ITEMS)
        rows = sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got.collect()], key=repr)
        assert rows == expected(want)
        kept = without_contaminated(table(spark, DOCS), items)
        assert kept.columns == table(spark, []).columns
        assert collected(kept, "doc_id") == expected([(w[0],) for w in want if not w[2]])

    def test_empty(self, spark):
        from mixhaz.llm.contamination import contamination

        items = spark.createDataFrame(self.ITEMS, "item_id long, text string")
        assert contamination(table(spark, []), items).count() == 0
        got = contamination(table(spark, DOCS[:3]), items.limit(0))
        assert collected(got, "doc_id", "n_hit") == [(0, 0), (1, 0), (2, 0)]


class TestLicenses:
    def test_base_places(self, spark):
        from mixhaz.llm.licenses import NOTICES, PHRASES, license_scan

        notice = NOTICES[3][1].split(" ")
        docs = DOCS + [(30, "a b " + " ".join(notice) + " c"), (31, " ".join(notice[:8] + ["inserted"] + notice[8:])), (32, "Licensed under CC BY-NC 4.0")]
        got = {}
        for r in license_scan(table(spark, docs)).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for doc, text in docs:
            n, places = brute.phrase_places(text, PHRASES)
            r = next(x for x in got[doc] if x["n_words"] == n)
            assert r["n_base"] == len(places)
            assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert 0 <= r["score"] <= 1
        assert sum(map(len, got.values())) == len(docs)
        assert got[30][0]["labels"] == got[31][0]["labels"] == "bsd" and got[32][0]["labels"] == "cc-by-nc"
        assert license_scan(table(spark, [])).count() == 0

    def test_related_notices(self, spark):
        from mixhaz.llm.licenses import NOTICES, license_scan

        text = dict(NOTICES)
        terms = "under the terms of the GNU %s as published by the Free Software Foundation"
        by = "This work is licensed under a Creative Commons Attribution%s License"
        want = {
            text["gpl"]: "gpl", terms % "General Public License": "gpl", terms % "Lesser General Public License": "gpl,lgpl",  # by its phrase, too
            text["gpl"].replace("General", "Lesser General"): "gpl,lgpl", by % " 4.0 International": "cc-by", by % " 3.0 Unported": "cc-by",
            by % "-ShareAlike 4.0 International": "", by % "-NonCommercial 4.0 International": "", "Licensed under CC BY-NC 4.0": "cc-by-nc",
            "Licensed under CC BY-NC 3.0": "cc-by-nc", "Licensed under CC BY 4.0": "", "Licensed under CC BY-NC-SA 4.0": "",
            text["mit"] + ". " + text["apache"]: "apache,mit",
        }
        got = {r["doc_id"]: r for r in license_scan(table(spark, enumerate(want))).collect()}
        assert {t: got[i]["labels"] for i, t in enumerate(want)} == want

    def test_competing_spans(self, spark):
        from pyspark.sql import functions as F

        from mixhaz.llm.licenses import _winners

        rows = [([(1, -0.9, 0, 20, "a"), (1, -0.8, 5, 15, "b"), (1, -0.7, 40, 50, "b"), (0, -0.7, 44, 60, "c")],)]
        df = spark.createDataFrame(rows, "s array<struct<rank int, loss double, start int, stop int, label string>>")
        kept = df.select(_winners(F.col("s")).alias("s")).first()["s"]
        assert [(x["label"], x["start"]) for x in kept] == [("c", 44), ("a", 0)]


class TestNearDuplicates:
    @pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
    def test_brute_force(self, spark, size, percent):
        from mixhaz.llm.near_duplicates import near_duplicates

        docs = DOCS + [(100 + i, changed(BASE, random.Random(i).sample(range(150), 1 + i % 7))) for i in range(40)]
        got = near_duplicates(table(spark, docs), size, percent)
        assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == expected(
            [(d, n, c, k) if d is not None else (d, n, None, True) for d, n, c, k in brute.near_duplicates(docs, size, percent)])

    def test_stage_and_empty(self, spark):
        from mixhaz.llm.near_duplicates import near_duplicates, without_near_duplicates

        assert near_duplicates(table(spark, [])).count() == 0
        assert without_near_duplicates(table(spark, [])).count() == 0
        other = prose(41, 90)
        # an id with a clean text and a copy; a group whose smallest id has two texts; equal rows
        docs = DOCS + [(30, prose(40, 90)), (30, changed(BASE, [5])), (31, other), (31, changed(other, [50])), (32, other), (31, other)]
        kept = without_near_duplicates(table(spark, docs))
        assert kept.columns == table(spark, []).columns
        judged = zip(docs, brute.near_duplicates([(i, t) for i, (_, t) in enumerate(docs)], 5, 80))
        groups = {}
        for (d, t), (i, n, c, _) in judged:
            groups.setdefault(c if n and d is not None else (i,), []).append((d, t))
        got = collected(kept, "doc_id", "text")
        want = []
        for group in groups.values():
            least = min(group, key=lambda x: (x[0] is not None, x[0] or 0))
            rows = [x for x in got if x in group and x[0] == least[0]]
            assert rows and (len(group) == 1 or len(set(rows)) == 1)
            want.append(rows[0])
        assert got == expected(want)

    def test_components(self, spark):
        from mixhaz.llm.near_duplicates import components

        chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
        got = components(spark.createDataFrame(chain, "a long, b long"))
        assert collected(got, "node", "component") == expected([(i, 0) for i in range(41)] + [(100, 100), (101, 100), (103, 100)])
        assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class TestToxicity:
    @pytest.fixture(scope="class")
    def corpus(self, spark):
        rng = random.Random(3)
        docs, labels = [], []
        for i in range(300):
            bad = i % 5 == 0
            words = prose(1000 + i, 40).split(" ")
            if bad:
                words.insert(rng.randrange(40), rng.choice(["moron", "idiot"]))
            docs.append((i, " ".join(words)))
            labels.append((i, int(bad)))
        hidden = [(900, "you 1d10t " + prose(50, 20)), (901, "such m o r o n here " + prose(51, 20)), (902, "what an idioooooot " + prose(52, 20)),
                  (903, prose(53, 30)), (904, None), (905, ""), (None, prose(54, 9)), (903, prose(53, 30))]
        label = spark.createDataFrame([*labels, (903, None), (None, 1)], "doc_id long, toxic int")
        return docs + hidden, label

    def test_scores(self, spark, corpus):
        from mixhaz.llm.toxicity import toxicity, without_toxic

        docs, labels = corpus
        rows = toxicity(table(spark, docs), labels).collect()
        assert len(rows) == len(docs)
        got = {r["doc_id"]: r for r in rows}
        for doc in (900, 901, 902):
            assert got[doc]["predicted"] == 1
        for doc in (903, 904, 905, None):
            assert got[doc]["predicted"] == 0
        for doc, r in got.items():
            assert r["held_out"] == (doc is None or zlib.crc32(str(doc).encode()) % 4 == 2)
            if doc is not None and doc < 300:
                assert r["predicted"] == int(doc % 5 == 0)
        kept = without_toxic(table(spark, docs), labels)
        assert kept.columns == table(spark, []).columns
        assert collected(kept, "doc_id") == expected([(d,) for d, _ in docs if got[d]["predicted"] == 0])

    def test_without_labels_or_rows(self, spark, corpus):
        from mixhaz.llm.toxicity import toxicity, without_toxic

        docs, labels = corpus
        assert {r["score"] for r in toxicity(table(spark, docs), labels.limit(0)).collect()} == {0.5}
        assert without_toxic(table(spark, docs), labels.limit(0)).count() == len(docs)
        assert toxicity(table(spark, []), labels).count() == 0

    def test_readings(self):
        from mixhaz.llm.toxicity import CLASSES, Restorer

        reader = Restorer(np.full((CLASSES,) * 3, -3.0))
        assert reader.text(b"a plain text, 2023!") == b"a plain text, 2023!"
        assert reader.text(b"i d i o t") == b"idiot"
        assert reader.text(b"ID-io") == b"id-io"


class TestQuality:
    def test_scores(self, spark):
        from mixhaz.llm.quality import quality

        docs = [(i, prose(i, 60) if i % 3 else " ".join(w + "$$$" for w in prose(i, 60).split(" "))) for i in range(240)]
        odd = [(900, None), (901, ""), (None, prose(5, 20)), (3, docs[3][1])]
        labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 0), (7, None)], "doc_id long, quality int")
        rows = quality(table(spark, docs + odd), labels).collect()
        assert len(rows) == len(docs) + len(odd)
        for r in rows:
            assert 0 <= r["score"] <= 1
            assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            if r["doc_id"] is not None and r["doc_id"] < 240:
                assert r["predicted"] == int(r["doc_id"] % 3 > 0)
        assert {r["score"] for r in quality(table(spark, docs[:5]), labels.limit(0)).collect()} == {0.5}
        assert quality(table(spark, []), labels).count() == 0


class TestPassages:
    @pytest.mark.parametrize("window", [50, 60])
    def test_brute_force(self, spark, window):
        from mixhaz.llm.recompression import passage_dedup

        got = passage_dedup(table(spark, DOCS), window)
        assert collected(got, "doc_id", "n_words", "n_removed", "kept") == expected(brute.earlier_passages(DOCS, window))

    def test_symbols_agree_inside(self):
        """Equal passages in different surroundings have the same symbols beyond the edge."""
        from mixhaz.llm.recompression import CAPS, edge, recompress

        rng = np.random.default_rng(0)
        for _ in range(200):
            alphabet = rng.integers(1, 1 << 63, rng.integers(2, 6), dtype=np.uint64)
            core = rng.choice(alphabet, 50)
            found = []
            for _ in range(2):
                left, right = rng.choice(alphabet, rng.integers(0, 30)), rng.choice(alphabet, rng.integers(0, 30))
                text = np.concatenate([left, core, right])
                start, span, name = recompress(text, np.zeros(len(text), np.int64))
                start = start - len(left)
                inner = (start >= edge(CAPS)) & (start + span <= 50 - edge(CAPS))
                found.append([tuple(x) for x in zip(start[inner], span[inner], name[inner])])
            assert found[0] == found[1] and found[0]

    def test_empty(self, spark):
        from mixhaz.llm.recompression import passage_dedup

        assert passage_dedup(table(spark, [])).count() == 0


class TestLattice:
    def test_base_and_counts(self, spark):
        import public_tokenizers as public
        from mixhaz.llm.lattice_lm import lattice_scores

        path = public.path("piece_bpe_32k.model")
        train = Counter()
        for doc, text in DOCS:
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 != 1:
                train.update([*brute.dark(text), None])
        n, v = sum(train.values()), len(train)
        for most in (500_000, 20):  # nearly all words are joined the second time
            rows = lattice_scores(table(spark, DOCS), path, most=most).collect()
            assert len(rows) == len(DOCS)
            want = []
            for doc, text in DOCS:
                w = [*brute.dark(text), None]
                base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
                want.append((doc, doc is None or zlib.crc32(str(doc).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), n, round(base, 6)))
            got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
            assert sorted(got, key=repr) == expected(want)
            assert all(r["score"] < 0 for r in rows)
        assert lattice_scores(table(spark, []), path).count() == 0

    def test_long_unseen_words(self, spark):
        import public_tokenizers as public

        from mixhaz.llm.lattice_lm import Lattice, lattice_scores, piece_weights

        path = public.path("piece_bpe_32k.model")
        ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:12]
        docs = [(i, prose(30 + i, 40)) for i in ids] + [(None, prose(30, 5) + " " + "漢字仮名" * 300 + " " + "q7Zx" * 500), (None, "é" * 2000)]
        train = Counter(w for i, t in docs if i is not None for w in [*brute.dark(t), None])
        n, v = sum(train.values()), len(train)
        lattice = Lattice(*piece_weights(path))

        def log_p(w):
            if w is None:
                return math.log((train[w] + 1) / (n + v + 1))
            x = float(lattice.log_sums([w.encode()])[0])
            return (np.logaddexp(math.log(train[w]), math.log(v) + x) if train[w] else math.log(v) + x) - math.log(n + v + 1)

        want = [round(sum(log_p(w) for w in [*brute.dark(t), None]) / math.log(10), 4) for _, t in docs]
        assert min(want) < -1000
        for most in (500_000, 0):  # sent to every task, joined
            plain = lattice_scores(table(spark, docs), path, most=most, rounds=0)
            assert sorted(round(r["score"], 4) for r in plain.collect()) == sorted(want)
            scores = [r["score"] for r in lattice_scores(table(spark, docs), path, most=most).collect()]
            assert all(map(math.isfinite, scores)) and sum(s < -1000 for s in scores) == 2

    def test_all_segmentations(self):
        from mixhaz.llm.lattice_lm import Lattice

        p = {b" ": 0.1, b" a": 0.2, b"a": 0.1, b"ab": 0.2, b" ab": 0.05, b"b": 0.15, b"aba": 0.2}
        lattice = Lattice(list(p), np.log(list(p.values())))

        def total(text):
            return 1.0 if not text else sum(q * total(text[len(k):]) for k, q in p.items() if text.startswith(k))

        words = [b"a", b"ab", b"abab", b"baab", b"c", b"ababababab"]
        for w, got in zip(words, lattice.log_sums(words)):
            assert math.isclose(np.exp(got), total(b" " + w), rel_tol=1e-9, abs_tol=1e-300)

        def cuts(text):
            if not text:
                yield 1.0, Counter()
            for k, q in p.items():
                if text.startswith(k):
                    for r, c in cuts(text[len(k):]):
                        yield q * r, c + Counter([k])

        want = Counter()
        for w in (w for w in words if w != b"c"):
            every = list(cuts(b" " + w))
            for q, c in every:
                for k, n in c.items():
                    want[k] += n * q / sum(x for x, _ in every)
        got = lattice.expected([w for w in words if w != b"c"])
        assert np.allclose(got, [want[k] for k in p])


class TestFingerprints:
    def test_rows(self, spark):
        import hashlib

        from mixhaz.llm.fingerprints import fingerprints

        docs = [(i, t) for i, t in DOCS if i not in (None, 11)]
        got = {r["doc_id"]: r for r in fingerprints(table(spark, docs)).collect()}
        assert len(got) == len(docs)
        shingles = {i: brute.near_duplicates([(i, t)], 5, 80)[0][1] for i, t in docs}
        for k, (i, t) in enumerate(docs):
            t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
            edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            if shingles[i] < 128:
                assert got[i]["n_shingles"] == shingles[i]
        assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
        assert got[4]["fingerprint"] == "" and got[4]["near_next"] == 1.0

    def test_odd_tables(self, spark):
        from mixhaz.llm.fingerprints import fingerprints

        assert fingerprints(table(spark, [])).count() == 0
        assert fingerprints(table(spark, DOCS)).count() == len(DOCS)
        one = fingerprints(table(spark, [(5, "abcd")])).collect()
        assert [(r["n_chars"], r["near_next"]) for r in one] == [(4, 1.0)]

    def test_estimates(self, spark):
        from pyspark.sql import functions as F

        from mixhaz.llm import fingerprints as fp

        data = spark.createDataFrame([(0,)], "x int").select(
            fp.sketch(F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda i: F.xxhash64(i)), 512).alias("a"),
            fp.sketch(F.transform(F.sequence(F.lit(3000), F.lit(8999)), lambda i: F.xxhash64(i)), 512).alias("b"),
            fp.sketch(F.transform(F.sequence(F.lit(0), F.lit(8999)), lambda i: F.xxhash64(i)), 512).alias("whole"))
        a, b = F.col("a"), F.col("b")
        r = data.select(fp.resemblance(a, b, 512).alias("j"), fp.containment(a, b, 512).alias("c"), fp.distinct_shingles(a, 512).alias("n"),
                        (fp.merged(a, b, 512) == F.col("whole")).alias("merges")).first()
        assert r["merges"] and abs(r["j"] - 1 / 3) < 0.08 and abs(r["c"] - 0.5) < 0.12 and abs(r["n"] - 6000) < 900


class TestBytePairs:
    def test_against_library(self, spark):
        import base64

        import tiktoken
        from mixhaz.llm.byte_pairs import encode_decode, public_vocabulary

        path, pattern = public_vocabulary()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        docs = [(i, t if i != 16 else "x" * 300) for i, t in DOCS] + [(40, "It's 12345 <|endoftext|>\r\n\t 日本語 😀  aaaaaaaaaaaaaaaaaaaaa ")]
        rows = encode_decode(table(spark, docs), path, pattern).collect()
        want = [(i, len(ids := code.encode_ordinary(t or "")), " ".join(map(str, ids)), (t or "").encode()) for i, t in docs]
        assert sorted([(r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in rows], key=repr) == expected(want)
        assert encode_decode(table(spark, []), path, pattern).count() == 0

    def test_long_match(self, spark):
        import base64

        import tiktoken
        from mixhaz.llm.byte_pairs import encode_decode, public_vocabulary

        path, pattern = public_vocabulary()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        docs = [(1, "x" * 4000), (2, prose(12, 3000).replace(" ", "")[:3000])]
        rows = encode_decode(table(spark, docs), path, pattern).collect()
        assert {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in rows} == {
            i: (" ".join(map(str, code.encode_ordinary(t))), t.encode()) for i, t in docs}

    def test_words_of_a_part_are_held_once(self, spark):
        """4 MB of few different words take little more than a list of references beside the text."""
        import tracemalloc

        import pyarrow as pa
        from mixhaz.llm.byte_pairs import encode_decode, public_vocabulary

        class Docs:
            sparkSession = spark

            def select(self, *names):
                return self

            def mapInArrow(self, run, schema):
                return run

        text = prose(31, 18000)
        run = encode_decode(Docs(), *public_vocabulary())
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [text] * 40})
        small = batch.slice(0, 1)

        def batches():
            yield small
            tracemalloc.start()
            yield batch

        found = [b.num_rows for b in run(batches())]
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert sum(found) == 41 and peak <= 48, peak


class TestSuffixArray:
    def test_order(self, spark):
        from mixhaz.llm.suffix_array import suffix_ranks

        rng = random.Random(1)
        strings = {s: [rng.choice([5, 7]) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 30]))] for s in range(10)}
        strings |= {20: [5] * 30, 21: [5] * 30, 22: strings[3]}
        data = spark.createDataFrame([(s, i, x) for s, v in strings.items() for i, x in enumerate(v)], "sid long, i int, x long")
        order = sorted(((s, i) for s, v in strings.items() for i in range(len(v))),
                       key=lambda t: [(1, x) for x in strings[t[0]][t[1]:]] + [(0, t[0])])
        got = {(r["sid"], r["i"]): r["rank"] for r in suffix_ranks(data).collect()}
        assert [got[k] for k in order] == list(range(len(order)))
        near = [tuple(strings[r["sid"]][r["i"]:r["i"] + 4]) for r in suffix_ranks(data, 4).orderBy("rank").collect()]
        runs = [k for n, k in enumerate(near) if n == 0 or near[n - 1] != k]
        assert len(runs) == len(set(runs))

    @pytest.mark.parametrize("length, gram", [(200, 100), (40, 16)])
    def test_brute_force(self, spark, length, gram):
        from mixhaz.llm.suffix_dedup import suffix_dedup

        got = suffix_dedup(table(spark, DOCS), length, gram)
        rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()]
        assert sorted(rows, key=repr) == expected(brute.repeated_bytes(DOCS, length))

    def test_no_python_for_offsets(self, spark):
        """The offsets of partitions come as a local table; a list of tuples would start further Python workers on each executor."""
        from mixhaz.llm import suffix_array as sa

        data = spark.range(50).select((F.col("id") * 7 % 50).alias("r"))
        found = sa.numbered(data, ["r"], "rank")
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.select("r", "rank").collect())) == [(i, i) for i in range(50)]
        last = sa._last_before(data, ["r"], [])
        assert "ExistingRDD" not in last._jdf.queryExecution().toString()
        assert [r["pred"] for r in last.orderBy("r").collect()] == [None, *range(49)]

    def test_memory_of_a_task(self, spark, monkeypatch):
        """A batch of 3 MB of texts takes little memory in each of the steps."""
        import gc
        import tracemalloc

        from mixhaz.llm import suffix_dedup as sd
        from mixhaz.llm import text as tx

        peaks, plain = [], sd.map_texts

        def measured(df, make, schema, column="text", **more):
            batches = tx.short_batches(df).toArrow().combine_chunks().to_batches()
            monkeypatch.setattr(tx, "_STATE", {})
            gc.collect()
            tracemalloc.start()
            for _ in tx.made(batches, make, column, **more):
                pass
            peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
            tracemalloc.stop()
            return plain(df, make, schema, column, **more)

        monkeypatch.setattr(sd, "map_texts", measured)
        common = prose(50, 3000)
        docs = [(i, prose(100 + i, 9000) + " " + common[i * 10:]) for i in range(48)]
        assert sd.without_repeats(table(spark, docs)).count() == len(docs)
        assert len(peaks) == 5 and max(peaks) <= 32, peaks

    def test_stage_and_empty(self, spark):
        from mixhaz.llm.suffix_dedup import suffix_dedup, without_repeats

        assert suffix_dedup(table(spark, [])).count() == 0
        kept = without_repeats(table(spark, DOCS))
        assert kept.columns == table(spark, []).columns and kept.count() == len(DOCS)
        want = [(d, b[4].decode("utf-8", "ignore")) for (d, t), b in zip(DOCS, brute.repeated_bytes(DOCS, 200)) if t is not None]
        got = [(r["doc_id"], r["text"]) for r in kept.collect() if r["text"] is not None]
        assert sorted((d if d is not None else -1, len(t) - len(x)) for (d, t), (_, x) in zip(sorted(got, key=repr), sorted(want, key=repr))) \
            and all(abs(len(a[1]) - len(b[1])) <= 4 for a, b in zip(sorted(got, key=lambda r: repr(r)), sorted(want, key=lambda r: repr(r))))


class TestPipeline:
    def test_stages(self, spark):
        """Every stage's rows follow from the operator's plain form on what the one before has kept."""
        import corpus_pipeline as p

        sf = "/root/testdata/sf0.001"
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
        columns = docs.columns
        for name, stage in p.STAGES:
            before = [(r["doc_id"], r["text"]) for r in docs.collect()]
            docs = p.cut(stage(spark, docs, sf))
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            if name != "tokens":
                assert docs.columns == columns
            if name == "toxicity":
                assert 0.8 * len(before) < len(after) < len(before)
            elif name == "near_duplicates":
                assert set(after) == {d for d, _, _, k in brute.near_duplicates(before, 5, 80) if k}
            elif name == "repeated_strings":
                assert set(after) == {d for d, _ in before}
                for d, n, removed, _, kept in brute.repeated_bytes(before, 200):
                    if not removed:
                        assert after[d].encode() == kept
                    assert abs(len(after[d].encode()) - len(kept)) <= 8
            elif name == "decontamination":
                assert set(after) == {r[0] for r in brute.contamination(before, items) if not r[2]}
            else:
                assert after == dict(before)
