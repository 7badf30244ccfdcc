"""The pipeline and what it is made of against brute force, on real texts and on rows that are odd in some way."""

import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from proofloom.llm import quality, sentencepiece_dropout, token_files
from test_operators import lines_brute, windows_hit

SF = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def scrambled(h):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * k & MASK
    return h ^ h >> 33


class Dropout:
    """One merge at a time over a text's characters, as the docstring of the operator has it."""

    def __init__(self, path, rate, seed):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.ids = {m.id_to_piece(i): i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in every if m.is_byte(i)}
        self.rank = {p: (-m.get_score(i), i) for p, i in self.ids.items()}
        self.rate, self.seed = int(rate * 2**64), seed
        self.meet = {(self.kind(a), self.kind(b)) for p in self.ids for a, b in zip(p, p[1:])}

    @staticmethod
    def kind(c):
        if c.isascii():
            return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        return "mark" if c == "▁" else "other"

    def encode(self, doc_id, text):
        if text is None:
            return None
        if not text:
            return []
        out, begin = [], 0
        text = "▁" + text.replace("▁", "\udcff").replace(" ", "▁")
        for end in range(1, len(text) + 1):
            if end == len(text) or (self.kind(text[end - 1]), self.kind(text[end])) not in self.meet:
                out += self.unit(doc_id, begin, text[begin:end])
                begin = end
        return out

    def unit(self, doc_id, begin, unit):
        occurrence = scrambled(xxhash.xxh64_intdigest(str(doc_id).encode(), self.seed) ^ scrambled(begin))
        own = sum(scrambled(ord(c) << 32 ^ i) for i, c in enumerate(unit)) & MASK
        key = scrambled(own ^ scrambled((occurrence + self.seed * 0x9E3779B97F4A7C15) & MASK))

        def skipped(a, b, c):
            bounds = scrambled((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & MASK)
            return scrambled(key ^ bounds) < self.rate

        cuts = list(range(len(unit) + 1))
        while True:
            ways = [(self.rank[p], i) for i, (a, b, c) in enumerate(zip(cuts, cuts[1:], cuts[2:])) if unit[a:b] in self.ids and unit[b:c] in self.ids and (p := unit[a:c]) in self.ids and not skipped(a, b, c)]
            if not ways:
                break
            del cuts[min(ways)[1] + 1]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            out += [self.ids[unit[a:b]]] if unit[a:b] in self.ids else [self.bytes[x] for x in unit[a:b].replace("\udcff", "▁").encode()]
        return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_dropout_by_brute_force(spark, rate):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    made = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect() if r.text]
    made += [(None, "null id"), (1, None), (2, ""), (3, "x" * 70 + " considerable considerable"), (3, "x" * 70 + " considerable considerable"), (4, "▁ own ▁marks, é 日本 Ünï\tcode\n123 4567")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in made], "doc_id long, text string, ids int, n_tokens int").repartition(3)
    brute = Dropout(path, rate, sentencepiece_dropout.SEED)
    got = sorted(((r.doc_id, r.text, r.ids, r.n_tokens) for r in sentencepiece_dropout.encode(docs, path, rate).collect()), key=str)
    assert got == sorted(((i, t, x, None if x is None else len(x)) for i, t in made for x in [brute.encode(i, t)]), key=str)


def grown_by_brute_force(x, y):
    """The trees one row and one split at a time; each is a list of nodes (feature, threshold) and of leaves."""
    q = quality
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    total = [np.log(p0 / (1 - p0))] * len(y)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, q.BINS + 1)[1:-1]).tolist())) for c in x.T]
    trees = []
    for _ in range(q.TREES):
        g = [1 / (1 + np.exp(-t)) - v for t, v in zip(total, y)]
        h = [max((p := 1 / (1 + np.exp(-t))) * (1 - p), 1e-6) for t in total]
        nodes, at = {}, [0] * len(y)
        for level in range(q.DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = [i for i in range(len(y)) if at[i] == node]
                best, gt, ht = (1e-6, 0, np.inf), sum(g[i] for i in rows), sum(h[i] for i in rows)
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        left = [i for i in rows if x[i, f] <= c]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl >= q.LEAST and ht - hl >= q.LEAST:
                            gain = gl**2 / (hl + q.RIDGE) + (gt - gl) ** 2 / (ht - hl + q.RIDGE) - gt**2 / (ht + q.RIDGE)
                            if gain > best[0] + 1e-9:
                                best = (gain, f, c)
                nodes[node] = best[1:]
            at = [2 * a + 1 + (x[i, nodes[a][0]] > nodes[a][1]) for i, a in enumerate(at)]
        leaves = {a: -q.RATE * sum(g[i] for i in range(len(y)) if at[i] == a) / (sum(h[i] for i in range(len(y)) if at[i] == a) + q.RIDGE) for a in set(at)}
        total = [t + leaves[a] for t, a in zip(total, at)]
        trees.append((nodes, leaves))
    return p0, trees


def test_trees_by_brute_force(monkeypatch):
    """Growth and traversal: the same scores as loops over rows and splits."""
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "DEPTH", 3)
    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(21)
    x = rng.random((160, 4)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2] * 3)  # ties
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    p0, trees = grown_by_brute_force(x, y)
    fresh = np.concatenate([x, rng.random((40, 4)).astype(np.float32)])
    want = []
    for row in fresh:
        t = np.log(p0 / (1 - p0))
        for nodes, leaves in trees:
            a = 0
            while a in nodes:
                a = 2 * a + 1 + int(row[nodes[a][0]] > nodes[a][1])
            t += leaves.get(a, 0.0)
        want.append(1 / (1 + np.exp(-t)))
    assert np.allclose(quality.grow(x, y).score(fresh), want, atol=1e-6)


def statistics_by_hand(text):
    """A few of the statistics, counted by characters and words."""
    words, lines, data = text.split(), text.split("\n"), text.encode()
    nw, nl, n = max(1, len(words)), max(1, len(lines)), max(1, len(data))
    return {0: np.log1p(len(data)), 1: np.log1p(len(words)), 3: len(text) / nw, 5: sum(b"A"[0] <= b <= b"Z"[0] for b in data) / n, 12: len(set(words)) / nw, 14: max([words.count(w) for w in words], default=0) / nw, 16: len(set(lines)) / nl, 17: sum(x[-1:] in (".", "!", "?") and x != "" for x in lines) / nl}


def test_statistics():
    for text in ["", "One. Two two\nTHREE! é 日本", "a a a\n\na.", "x" * 5000, "\n\n", "12 | 34 {} https://x.y/z?"]:
        got = quality.statistics(text)
        assert len(got) == quality.N_FEATURES and all(np.isfinite(got))
        assert all(got[i] == pytest.approx(v) for i, v in statistics_by_hand(text).items())


def test_quality_keeps_columns_and_ignores_labels_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "'x' AS score", "1 AS x", "true AS held_out", "2 AS quality")
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = {r.doc_id: r.score for r in quality.judge(docs, labels).collect()}
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    assert one == {r.doc_id: r.score for r in quality.judge(docs, turned).collect()}


def test_numbers_are_read_by_ranges(tmp_path, monkeypatch):
    values = np.arange(1000, dtype="<u2")
    (tmp_path / "x.ids").write_bytes(values.tobytes())
    uri = f"file://{tmp_path}/x.ids"
    mapped = token_files._Numbers(uri, "<u2", 1000)
    monkeypatch.setattr(token_files, "local_path", lambda uri: None)
    ranged = token_files._Numbers(uri, "<u2", 1000)
    assert ranged.all is None and mapped.all is not None
    assert (ranged.read(10, 990) == values[10:990]).all() and (mapped.read(10, 990) == values[10:990]).all()


def run_by_brute_force(rows, labels, items, path):
    """(doc_id, text, ids) that run() leaves of rows (doc_id, text)."""
    scored = sorted((i, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5)
    learned = [(t, q) for i, q in scored for j, t in rows if i == j]
    trees = quality.grow(np.array([quality.statistics(t or "") for t, _ in learned], np.float32).reshape(-1, quality.N_FEATURES), np.array([float(q) for _, q in learned]))

    def score(text):
        x, t = np.array(quality.statistics(text or ""), np.float32), trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            a = 0
            for _ in range(quality.DEPTH):
                a = 2 * a + 1 + int(x[feature[a]] > threshold[a])
            t += leaf[a - 2**quality.DEPTH + 1]
        return 1 / (1 + np.exp(-t))

    rows = [(i, t) for i, t in rows if score(t) >= quality.THRESHOLD]
    lines = lambda t: sum(1 for x in (t or "").split("\n") if x.strip())
    left = lines_brute(rows)
    rows = [(i, x) for i, t in rows for x in [left[i, t]] if not lines(t) or lines(x)]
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        if i is not None and w:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    rows = [(i, t) for i, t in rows if i not in parent or find(i) == i]
    hit = windows_hit(rows, items)
    rows = [r for r, h in zip(rows, hit, strict=True) if not h[5]]
    brute = Dropout(path, sentencepiece_dropout.RATE, sentencepiece_dropout.SEED)
    return [(i, t, brute.encode(i, t)) for i, t in rows]


def test_run_by_brute_force(spark, tmp_path):
    """All five stages over real texts, copies, near copies, passages, and rows that are odd in some way."""
    import public_tokenizers

    import corpus_pipeline

    rng = np.random.default_rng(22)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) < 1200][:70]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = " ".join(rng.choice(words, 80)) + "."
    near = base.split()
    near[40] = "other"
    passage = " ".join(max((t for _, t in items if t), key=len).split()[:14])
    made = [*real, (5000, base), (5001, " ".join(near)), (5002, base), (5003, f"Before it. {passage.upper()} and after."), (5004, None), (5005, ""), (5006, " \n\t"), (None, "A text without an id."), (5007, real[0][1]), (5007, "Another text of the same id."), (5008, "Twice the same row."), (5008, "Twice the same row."), (5009, "Line one of this.\nLine one of this.\n\nanother line here"), (5010, "long " * 4000)]
    (tmp_path / "sf").mkdir()
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone int, ids string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in made], schema).repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/sf/{name}.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert out.columns == [*corpus_pipeline.COLUMNS, "ids", "n_tokens"]
    rows = out.collect()
    want = run_by_brute_force(made, labels, items, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(((r.doc_id, r.text, r.ids) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert 5003 not in {r.doc_id for r in rows} and len(rows) < len(made) - 8


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and set(corpus_pipeline.COLUMNS) <= set(out.columns), name
