"""Text operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import chat, jaccard, kernels, language, mixing, token_files, toxicity

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, words, "de", "a", 9), (4, words, "de", "a", 9), (5, words, "de", "a", 9), (6, " \n\t", "en", "b", 1), (7, "one", "en", None, 3), (7, "one", "en", None, 3), (8, "One two\tthree", "en", "b", 3), (None, "one two three", "fr", "b", 3), (9, "1234 !!", "fr", "a", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("n", "fp", "row_id", "size", "rate", "target", "part", "score", "gram", "__size"):
        docs = docs.selectExpr("*", f"doc_id AS {c}")
    return docs


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def grams(t, k=4):
    w = split(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows):
    own = {i: grams(t) for i, t in rows}
    inv, up = defaultdict(list), {i: i for i in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in own.items():
        c = Counter(j for g in s for j in inv[g])
        for j, o in c.items():
            if 100 * o >= 85 * (len(s) + len(own[j]) - o):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for g in s:
            inv[g].append(i)
    return {i: (len(s), find(i)) for i, s in own.items()}


def test_word_hashes_follow_words():
    texts = ["A bé c\x0bd", None, "", "bé", "  x ", "c D"]
    data, at = kernels.text_buffer(pa.array(texts))
    h, hat = kernels.word_hashes(data, at)
    flat = [w for t in texts for w in split(t)]
    assert list(np.diff(hat)) == [len(split(t)) for t in texts]
    assert len({(w, x) for w, x in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force_on_dense_groups(spark, seed):
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(4000)}"
    rows = []
    for g in range(3):
        base = [word() for _ in range(int(draw.integers(30, 120)))]
        for _ in range(150):
            t = list(base)
            for _ in range(int(draw.integers(0, 4))):
                t[draw.integers(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(int(draw.integers(1, 40))))) for k in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_blocks_of_long_lists(spark, seed, monkeypatch):
    """Many small blocks: groups of near copies that share lists with others, joined through representatives, and a stock phrase."""
    for name, value in (("BLOCK_SETS", 12), ("MANY", 24), ("SHORT_LIST", 6)):
        monkeypatch.setattr(jaccard, name, value)
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(3000)}"
    rows, stock = [], [word() for _ in range(25)]
    base = [word() for _ in range(60)]
    for g, (copies, edits) in enumerate(((150, 2), (80, 5), (60, 1), (40, 9))):
        own = list(base)
        for k in range(0, 60, 7):  # groups are alike, too far for links but for edits
            if draw.random() < 0.1 * g:
                own[k] = word()
        for _ in range(copies):
            t = list(own)
            for _ in range(int(draw.integers(0, edits + 1))):
                t[draw.integers(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + k, " ".join([word() for _ in range(6)] + stock + [word() for _ in range(int(draw.integers(1, 12)))])) for k in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 60 and got == want


def test_answers_start_from_what_is_joined():
    base = np.arange(100, dtype=np.uint64)
    left = [np.append(base[:99], np.uint64(200 + k)) for k in range(3)]
    right = [np.append(base[:99], np.uint64(300 + k)) for k in range(3)]
    assert len(jaccard.answers(left, right, 85)) == 5
    assert len(jaccard.answers(left, right, 85, np.array([1, 1, 1, 9, 9, 9]))) == 1
    assert jaccard.answers(left, right, 85, np.array([4] * 6)) == []


def test_answers_connect_as_all_pairs_do():
    draw = np.random.default_rng(5)
    for two in (False, True):
        base = draw.integers(0, 1 << 40, 60).astype(np.uint64)
        make = lambda: np.unique(np.concatenate([base[draw.random(60) < 0.93], draw.integers(0, 1 << 40, 3).astype(np.uint64)]))  # noqa: E731, B023
        left, right = [make() for _ in range(40)], [make() for _ in range(30)] if two else None
        every = left + (right or [])

        def roots(links):
            up = list(range(len(every)))
            for a, b in links:
                ra, rb = up[a], up[b]
                up = [ra if x == rb else x for x in up]
            return [[up.index(x)] for x in up]

        pairs = [(a, b) for a in range(len(left)) for b in (range(a + 1, len(left)) if not two else range(len(left), len(every)))]
        true = [(a, b) for a, b in pairs if 100 * (o := len(np.intersect1d(every[a], every[b]))) >= 85 * (len(every[a]) + len(every[b]) - o)]
        found = jaccard.answers(left, right, 85)
        assert {tuple(sorted(x)) for x in found} <= set(true)
        assert roots(found) == roots(true) and len(found) < len(every)


def test_jaccard_edges(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(edge_docs(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (6, 0, 6), (7, 1, 7), (9, 1, 9), (8, 1, 8), (None, 1, 8), (3, 29997, 3), (5, 29997, 3)} <= got
    assert jaccard.jaccard_components(edge_docs(spark).limit(0)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_edges(spark):
    rows = language.language_table(edge_docs(spark)).collect()
    assert len(rows) == 11 and {r.doc_id: r.lang_pred for r in rows}[9] == "und"
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows}[1] == ("und", 0.0)
    assert language.language_table(edge_docs(spark).limit(0)).count() == 0


def test_language_learns_every_label(spark, monkeypatch):
    """600 labels, each with words of its own; features are folded."""
    draw = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in draw.integers(0, 26, 5)) for _ in range(600 * 4)]
    rows = [(k, " ".join(draw.choice(words[4 * (k % 600) : 4 * (k % 600) + 4], 12)), f"l{k % 600:03d}") for k in range(600 * 6)]
    monkeypatch.setattr(language, "MOST_WEIGHTS", 600 * 8192)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 600 and len(model.idf) == 8192
    held = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([model.predict(t)[0] == y for t, y in held]) > 0.9


def test_features_are_counts_of_grams():
    ids, counts = language.features("Ab ab, C")
    assert counts.sum() == 9 + 8 + 7 and len(ids) == len({*" ab c ", *(" ab ab c "[i : i + 2] for i in range(8)), *(" ab ab c "[i : i + 3] for i in range(7))})
    small, some = language.folded(ids, counts, 4)
    assert some.sum() == counts.sum() and len(small) <= 4


def test_segments_are_maximal():
    assert toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.segments(np.array([-1.0, -2])) == []
    draw = np.random.default_rng(0)
    for _ in range(200):
        s = draw.normal(-0.3, 1, 30)
        total = np.concatenate([[0], np.cumsum(s)])
        best = max(total[b] - total[a] for a in range(31) for b in range(a, 31))
        assert max((x[2] for x in toxicity.segments(s)), default=0.0) == pytest.approx(max(best, 0.0))


def test_toxic_passages_after_the_first_are_found():
    draw = np.random.default_rng(4)
    clean = lambda n: (np.full(n, -1.5), draw.integers(100, 10**9, n))
    passage = np.full(8, 4.0), np.arange(8)
    text = lambda *parts: map(np.concatenate, zip(*parts))
    # Two equal passages, and again the same words before both, each alone.
    once = [x for k in range(8) for x in ((np.array([4.0]), np.array([k])), clean(20))]
    for early in ([], once):
        found = toxicity.segments(toxicity.first_uses(*text(*early, clean(300), passage, clean(300), passage, clean(50))))
        assert [x[2] for x in found if x[2] > 20] == [32.0, 32.0]
    # Within a passage a word counts once.
    assert max(x[2] for x in toxicity.segments(toxicity.first_uses(*text(passage, passage)))) == 32.0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_table(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r.score for r in rows if r.toxic == 1]
    miss = [r.score for r in rows if r.toxic == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in hit for b in miss]) > 0.8
    assert sum(s >= 0.3 for s in miss) <= 0.05 * len(miss)
    assert sum(s >= 0.3 for s in hit) >= 0.6 * len(hit)  # 37 toxic documents to learn from


def test_toxicity_recall_with_more_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_table(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.toxicity_table(edge_docs(spark), labels).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_table(edge_docs(spark).limit(0), none).count() == 0


def test_mixing_takes_near_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_table(docs).collect()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
    assert sum(r.size for r in rows) == total
    assert all(r.taken <= 2 * r.size for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - 1.5 * total) < 1e-3 * total
    assert abs(sum(r.taken for r in rows) / (1.5 * total) - 1) < 0.1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_table(docs).collect()))


def test_mixing_edges(spark):
    rows = mixing.mix_table(edge_docs(spark)).collect()
    assert len(rows) == 11 and {r.doc_id: r.size for r in rows}[1] == 0
    out = mixing.mixed(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns and out.count() >= 0
    assert mixing.mix_table(edge_docs(spark).where("text is null")).first().target == 0
    assert mixing.mix_table(edge_docs(spark).limit(0)).count() == 0


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files_equal_plain_encoding(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    odd = ["don't <|endoftext|>x", "é ́a", "A B c\x1cd", "İI ΣΣ 1234's", "a\r\nb\x0bc\x85d", "ﬁ ẛ̣"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(-k, t) for k, t in enumerate(odd, 1)] + [(5000, None), (5001, "")]
    got = {r.doc_id: r for r in token_files.token_table(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path()).collect()}
    start = 0
    for i, t in sorted(docs):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_token_file_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_files.write_token_files(spark.read.parquet(f"{DATA}/documents.parquet"), str(tmp_path / "t"), tokenizer_path())
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/t/*.parquet"))[0]).metadata
    assert meta.row_group(0).column(0).has_offset_index
    used = {str(e) for k in range(meta.num_columns) for e in meta.row_group(0).column(k).encodings}
    assert used & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"}


def test_token_edges(spark):
    rows = token_files.token_table(edge_docs(spark), tokenizer_path()).collect()
    assert len(rows) == 11 and {r.doc_id: r.n_tokens for r in rows}[1] == 1
    assert token_files.token_table(edge_docs(spark).limit(0), tokenizer_path()).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\<|", "<<|", "<\\|im_end|>", None, "", "é\U0001f600\n\n", "a" * 5000, "<|im_start|>" * 50]
    rows = [(c, t, ("user", "assistant", "a\nb<|\\", None)[(c + t) % 4], nasty[(c * 3 + t) % len(nasty)]) for c in range(20) for t in range(c % 7 + 1)]
    got = {r.conv_id: r for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in range(20):
        own = [(r or "", t or "") for i, _, r, t in sorted(rows, key=lambda x: x[:2]) if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_long_conversation_comes_in_parts(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat(string(id), 1000) AS text")
    parts = chat.format_chats(rows).select("conv_id", "part", "formatted").collect()
    assert len(parts) > 1 and [p.part for p in parts] == list(range(len(parts)))
    turns = [t for p in parts for t in chat.parse(p.formatted)]
    assert turns == [(("user", "assistant")[k % 2], str(k) * 1000) for k in range(3000)]


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, part long, formatted string"
    rows = [(None, None, None, None, 1, "x"), (1, 0, "user", "a", 1, "x"), (1, 0, "user", "a", 1, "x"), (1, None, "assistant", "b", 1, "x")]
    got = {r.conv_id: r.n_turns for r in chat.chat_digest(spark.createDataFrame(rows, kind)).collect()}
    assert got == {None: 1, 1: 3}
    assert chat.chat_digest(spark.createDataFrame([], kind)).count() == 0
