import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from nearsieve.llm import packing, tokenfile
from nearsieve.llm.env import shared_dir
from nearsieve.llm.tokens import Encoder

ODD = [None, "", " ", "a  b", " lead", "trail ", "x\n\n y", "x \n\t z", "it's 'S don't x'll'll", "<|endoftext|> <|startoftext|>", "Ünï çödé ß É", "中文 text", "é", "5 55 5.5!?", "a\x85b c\x1cd", "no\nspace", "\n", "''s ''", "q" * 300]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_tokenizers(name, spaced, prose):
    own, public = Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(3)
    mixed = ["".join(r.choice(["a", "B", "é", " ", "  ", "\n", "\t", "'s", "7", ".", "!", "'"]) for _ in range(40)) for _ in range(400)]
    for t in ODD + mixed + [prose(3000, 1)]:
        assert list(own.ids(t)) == public.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_many_texts_have_the_ids_of_each(name, spaced, prose):
    own, public = Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(4)
    signs = ["a", "Bo", "reS", "é", "ǅ", "ª", "²", "»", "×", " ", " ", "\n", "'s", "'re", "'ll", "'v", "'", "7", "10", ".", "!?", "$$", "_"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts += ["x" + chr(c) + "1" + chr(c) + " " + chr(c) + "'t" for c in range(0x250)]
    texts += ["aaaaaaaaaaaaa aaaaaaaa", "w " + "q" * 300 + " é" + "ä" * 23 + " " + "ä" * 24 + "b end", "'s", "'", "l'", "l", "l'r", "e", "'re're'lls's'd3'm", prose(3000, 1).replace(" ", ".\n", 50)] + ODD
    for kind in (pa.string(), pa.large_string()):
        found = own.many(pa.array([None, *texts], kind)[1:])
        assert all(x.dtype == np.uint32 for x in found)
        for t, x in zip(texts, found, strict=True):
            assert x.tolist() == public.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert own.many(pa.array([], pa.string())) == []


def test_new_words_of_plain_texts_are_merged_together(prose):
    """Invented words are nearly all new; one call each to the tokenizer made most of op7's time."""
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [prose(200, i) + ".\nIt's" for i in range(50)]
    own.many(pa.array(texts))
    assert not own.known and not own.after_space  # what texts met one at a time leave
    calls = []
    own.ids = lambda text: calls.append(text) or []
    own.many(pa.array([*texts, "two  spaces"]))
    assert calls == ["two  spaces"]


def test_new_words_of_a_token_file_are_merged_together(prose):
    """A token file's words are nearly all new too: a call each made op2 too slow."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, public = Encoder(path, False), Tokenizer.from_file(path)
    texts = [None, "", " \n", "  It's\t'LL\r\n\n 10²x", *(prose(200, i) + ".\nIt's" for i in range(50)), "İ Ⱥ", "中 a", "x"]
    batches = [pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])] * 2
    calls, ids = [], own.ids
    own.ids = lambda text: calls.append(text) or ids(text)
    for end in (None, 2):
        found = list(tokenfile.encoded(batches, own, end))
        assert [i for i, _ in found] == [*range(len(texts))] * 2
        for (_, x), t in zip(found, texts * 2, strict=True):
            assert x.dtype == np.uint32 and x.tolist() == public.encode(t or "", add_special_tokens=False).ids + [end] * (end is not None), repr(t)
    assert calls == [None, "", " \n", "İ Ⱥ", "中 a"] * 4


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8) and (tokenfile.unpack(raw, 1000, bits) == ids).all()


def test_file_gives_random_access(tmp_path):
    r = np.random.default_rng(0)
    docs = [(i * 3, r.integers(0, 30_000, n).astype(np.uint32)) for i, n in enumerate([0, 1, 500, 0, 64, 130, 3])]
    (tmp_path / "f").write_bytes(b"".join(tokenfile.file_chunks(docs, 15, 64)))
    file = tokenfile.TokenFile(str(tmp_path / "f"))
    assert file.doc_ids.tolist() == [d for d, _ in docs] and file.bits == 15
    for i, (_, ids) in enumerate(docs):
        assert (file.ids(i) == ids).all()
    whole = np.concatenate([x for _, x in docs])
    assert (file.span(60, 200) == whole[60:200]).all()
    with pytest.raises(ValueError):
        list(tokenfile.file_chunks([(1, np.array([1 << 15], np.uint32))], 15))


def test_token_files_of_a_table(spark, documents, prose):
    rows = [(5, prose(40, 1)), (2, None), (9, ""), (7, prose(9000, 2)), (3, "same"), (3, "same"), (-4, "neg")]
    path = public_tokenizers.path("word_bpe_49k.json")
    public = Tokenizer.from_file(path)
    manifest = tokenfile.write_tokens(documents(rows), shared_dir(spark, "t"), path, 49_408)
    found = sorted(tokenfile.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    for r, (_, t) in zip(found, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = public.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = tokenfile.write_tokens(documents([]), shared_dir(spark, "t"), path, 49_408)
    assert empty.count() == 0 and tokenfile.read_tokens(spark, empty).count() == 0
    last = tokenfile.write_tokens(documents([(None, "a"), *rows, (None, None), (-1, "b")]), shared_dir(spark, "t"), path, 49_408)
    found = sorted(tokenfile.read_tokens(spark, last).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [-4, -1, 2, 3, 3, 5, 7, 9, None, None]


def test_differencing_balances_and_windows_grow():
    r = random.Random(5)
    sizes = [r.randint(1, 200) for _ in range(160)]
    parts = packing.differencing(sizes, 16)
    assert sorted(i for p in parts for i in p) == list(range(160))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3
    assert packing.differencing([8, 7, 6, 5, 4], 2)  # the classic example: difference 2
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    grown = packing.windows([700, 700, 700], 1024)
    assert len(grown) == 3


def test_pieces_hold_every_id_once(spark, documents, prose):
    rows = [(i, prose(5 + 97 * i % 900, i)) for i in range(120)] + [(200, None), (201, ""), (202, prose(6000, 3)), (3, prose(10, 3)), (None, "no id")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    public = Tokenizer.from_file(path)
    found = packing.pack_documents(documents(rows).repartition(3), path).collect()
    windows, docs = defaultdict(list), defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append(r)
    padded = total = 0
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 1024 - at)
    assert padded < 0.01 * total
    for i, t in rows:
        ids = np.array([*public.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces, at = sorted(docs[i, len(ids)], key=lambda r: r.start), 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(documents([]), path).count() == 0
