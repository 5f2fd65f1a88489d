import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import id_codec, packing, substring_dedup, token_store, tokens
from quire.llm.common import new_path
from quire.llm.text_hash import shingle_sets, text_bytes
from quire.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(5, None), (3, ""), (4, " \n"), (9, "Don't  stop, we'll go.\tOK?"), (7, "a<|endoftext|>B c.<|startoftext|>"), (8, "İstanbul ΣΑΣ ½ é H̱ x.…y É!É"), (1, "long words here, " * 9000), (2, "long words here, " * 9000), (9, "Don't  stop, we'll go.\tOK?"), (None, "no id")]


def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aAbB é̱́.,'!?<|>\n\t1", max_size=30)), min_size=1, max_size=6))
def test_ids_by_word_are_the_librarys(texts):
    ids, at = WordTokenizer(PATH).encode(pa.array(texts, pa.string()))
    whole = [e.ids for e in model().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(1, 60))
def test_codec_round_trip(ids, block):
    c = id_codec.encode(np.array(ids, np.int64), block)
    assert id_codec.decode(c).tolist() == ids
    if len(c["words"]) > 1:  # blocks are independent
        assert id_codec.decode(c, 1, 1).tolist() == ids[block : 2 * block]


def test_codec_compresses_repeats_and_notices_damage():
    ids = np.tile(np.arange(500, 540), 300)
    c = id_codec.encode(ids)
    assert len(c["data"]) * 8 < len(ids)
    broken = bytearray(c["data"])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        id_codec.decode(c | {"data": bytes(broken)})


def expected(rows, end):
    m = model()
    return [(i, np.array([*m.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in rows]


def test_token_files(spark, make_docs):
    folder = new_path(spark, "t")
    docs = make_docs(ODD)
    manifest = token_store.write_tokens(docs, folder, tokenizer=PATH, chunk_ids=20_000, block=512)
    out = token_store.read_tokens(manifest).orderBy("start").collect()
    want = sorted(expected(ODD, 1), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.doc_id, bytes(r.ids)) for r in out] == want
    assert [r.start for r in out] == [int(x) for x in np.cumsum([0] + [len(b) // 4 for _, b in want])[:-1]]
    again = token_store.read_tokens(token_store.list_chunks(spark, folder)).orderBy("start").collect()
    assert again == out
    assert token_store.stored_tokens(docs.limit(0), tokenizer=PATH).count() == 0


def check_packing(pieces, rows, capacity, end):
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(b) // 4 for _, b in expected(rows, end))
    assert sum(p.length for p in pieces) == total
    assert len(seqs) == -(-total // capacity)
    assert sorted(seqs) == list(range(len(seqs)))
    return docs


def test_packing(spark, make_docs):
    rows = [(i, t) for i, t in ODD if i is not None][:-1] + [(100 + i, "word " * (i % 9)) for i in range(300)] + [(1000 + i, "the same text again") for i in range(400)]
    out = packing.pack_documents(make_docs(rows).repartition(5), tokenizer=PATH, capacity=64).collect()
    docs = check_packing(out, rows, 64, 2)
    for i, ids in expected(rows, 2):
        parts = sorted(docs[i, len(ids) // 4], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in parts) == ids
        assert [p.start for p in parts] == [int(x) for x in np.cumsum([0] + [p.length for p in parts])[:-1]]
    assert packing.pack_documents(make_docs([]), tokenizer=PATH).count() == 0
    assert packing.pack_documents(make_docs([(None, None), (1, "a"), (1, "a")]), tokenizer=PATH).count() == 3


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 30))
def test_fill_is_the_best_subset_sum(counts, room):
    taken = packing.fill(counts, room)
    sums = {0}
    for x, c in counts.items():
        sums = {s + x * k for s in sums for k in range(c + 1) if s + x * k <= room}
    assert sum(x * k for x, k in taken.items()) == max(sums)
    assert all(k <= counts[x] for x, k in taken.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 200), max_size=8))
def test_plan_places_every_id_once(counts):
    h = np.zeros(16, np.int64)
    for x, c in counts.items():
        h[x] = c
    segments, sequences = packing.plan(h, 16)
    placed = sum(int(s[2]) * int(s[6] or s[0]) for s in segments)
    assert placed == int((h * np.arange(16)).sum())
    assert sequences == -(-placed // 16)


def test_chunk_checksum():
    data = token_store.pack_chunk(np.array([1, 2]), np.array([2, 1]), np.array([5, 1, 1]), 16)
    assert [x.tolist() for x in token_store.unpack_chunk(data)] == [[1, 2], [2, 1], [5, 1, 1]]
    with pytest.raises((ValueError, zlib.error)):
        token_store.unpack_chunk(data[:14] + bytes([data[14] ^ 255]) + data[15:])


def thue_morse(k):
    """A word of 2**k letters and its complement: equal under every polynomial hash modulo 2**64 with an odd base, if k is large."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [4, 10, 12])
def test_long_words_that_differ_keep_their_own_ids(k):
    pair = thue_morse(k)
    tok = WordTokenizer(PATH)
    ids, at = tok.encode(pa.array(pair))
    for i, word in enumerate(pair):
        assert ids[at[i] : at[i + 1]].tolist() == tok.model.encode(word, add_special_tokens=False).ids
    a, b = shingle_sets(pa.array(pair), 4)
    assert len(a) == len(b) == 1 and a[0] != b[0]
    sentence = [" ".join("yes" if c == "a" else "no" for c in word) for word in pair]
    raw, offsets = text_bytes(pa.array(sentence))
    assert len(set(substring_dedup.sentences(raw, offsets)[1].tolist())) == 2


def test_cache_of_words_is_cut_back(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED_WORDS", 50)
    tok = WordTokenizer(PATH)
    for i in range(12):
        text = "common words stay here " + " ".join(f"w{chr(97 + j % 26)}{'abcdef'[i % 6]}{'xyz'[j // 26]}" for j in range(70))
        ids, _ = tok.encode(pa.array([text]))
        assert ids.tolist() == tok.model.encode(text, add_special_tokens=False).ids
        assert tok.words <= 50 + 80


def test_blocks_decode_alone_and_start_alike():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 60, 1037)
    c = id_codec.encode(ids, 100)
    for first, count in ((0, 1), (3, 2), (10, 1), (0, 11)):
        assert id_codec.decode(c, first, count).tolist() == ids[first * 100 : (first + count) * 100].tolist()


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300))
@settings(deadline=None, max_examples=50)
def test_shares_sum_up(counts):
    got = id_codec.shares(np.sort(np.array(counts))[::-1])
    assert got.sum() == 1 << 18 and got.min() >= 1


def test_shares_of_as_many_ids_as_can_be_coded():
    most = 1 << id_codec._F
    assert id_codec.shares(np.ones(most, np.int64)).tolist() == [1] * most
    with pytest.raises(ValueError, match="different ids"):
        id_codec.shares(np.ones(most + 1, np.int64))


def stepped(slots, ids, none, one):
    """What _found gives for a block, step by step."""
    held, out = {}, []
    for slot, x in zip(slots, ids, strict=True):
        last, sure = held.get(slot, (none, 0))
        out.append(16 * last + one * sure)
        held[slot] = (x, min(sure + 1, 3) if x == last else 1)
    return out


@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(0, 2)), min_size=1, max_size=80), st.sampled_from([1, 4]), st.integers(1, 3))
@settings(deadline=None, max_examples=60)
def test_sorted_contexts_find_what_slots_would_hold(pairs, one, times):
    pairs = pairs * times
    slots, ids = (np.array([c, c[::-1]], np.int32) for c in zip(*pairs, strict=True))
    got = id_codec._found(slots, ids, 7, one)
    assert got.tolist() == [stepped((s & (id_codec._SLOTS - 1)).tolist(), x.tolist(), 7, one) for s, x in zip(slots, ids, strict=True)]


@pytest.mark.parametrize(("blocks", "calls"), [(1, 1), (4, 1), (5, 1), (8, 2), (9, 2)])
def test_a_few_blocks_more_are_coded_beside_the_others(monkeypatch, blocks, calls):
    seen = []
    for name in ("_encode", "_decode"):
        inner = getattr(id_codec, name)
        monkeypatch.setattr(id_codec, name, lambda *a, f=inner, k=name: seen.append(k) or f(*a))
    monkeypatch.setattr(id_codec, "LANES", 4)
    ids = np.arange(16 * blocks - 3) % 11
    assert id_codec.decode(id_codec.encode(ids, 16)).tolist() == ids.tolist()
    assert seen == ["_encode"] * calls + ["_decode"] * calls


def test_coded_bytes_stay_as_they_are():
    """Chunks that were written before are read."""
    ids = (np.arange(20_000) ** 2 // 700 * 31) % 997
    ids[5_000:9_000] = ids[:4_000]
    c = id_codec.encode(ids, 1_000)
    assert (len(c["data"]), zlib.crc32(c["data"]), zlib.crc32(c["words"].tobytes()), zlib.crc32(c["crc"].tobytes())) == (23114, 2924549017, 153650656, 3242880323)
