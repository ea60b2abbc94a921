"""Token files against the tokenizers library, byte by byte, and the reader's care."""

import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from partonframe.llm import token_files
from partonframe.llm.bpe import read_tokenizer
from partonframe.llm.queries import word_tokenizer_path
from tests.llm.cases import ROWS, prose, table

SPEC = read_tokenizer(word_tokenizer_path())


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_str(SPEC)
    made.no_truncation()
    made.no_padding()
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


def written(spark, tmp_path, rows, **options):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(table(spark, rows), SPEC, path, **options)
    return path


def blobs(tmp_path):
    found = [open(f, "rb").read() for f in glob.glob(f"{tmp_path}/files/part-*")]
    files = [token_files.TokenFile(b) for b in found if b]
    return [b for _, b in sorted(((f.part, f.number), b) for f, b in zip(files, [b for b in found if b], strict=True))]


AWKWARD = ROWS + [
    (20, "<|endoftext|> and<|startoftext|>inside  <|endoftext|>\t", None, None), (21, "a\x0bb\x0cc\x85d\xa0e f\x1cg　", None, None),
    (22, "é é ́x 'S don't WE'LL 12345 ½ ﬁ ​ İ ẞ", None, None), (23, "x" * 5000 + " " + "Ж" * 3000, None, None), (-(1 << 62), "least", None, None), (1 << 62, "last", None, None),
]


def brute(library, rows):
    """{(id, start, n, crc)} of the rows in order; those of one id in the order that the files have them."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r[0], library(r[1])) for r in order]


def test_awkward_rows_equal_the_library(spark, tmp_path, library):
    path = written(spark, tmp_path, AWKWARD, shard_bytes=300)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = brute(library, AWKWARD)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids) for i, ids in want)
    crc = {r.start: r.ids_crc32 for r in token_files.read_token_files(spark, path, digests=True).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    facts = token_files.token_file_facts(spark, path).collect()
    assert len(facts) >= 3 and sum(f.n_docs for f in facts) == len(AWKWARD) and sum(f.n_ids for f in facts) == at


def test_any_decoder_reads_a_file(spark, tmp_path, library):
    rng = random.Random(1)
    rows = [(i, prose(rng, 200), "en", "s") for i in range(50)]
    written(spark, tmp_path, rows, shard_bytes=4000)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(b, read_across_frames=True).read() for b in blobs(tmp_path))
    assert np.frombuffer(whole, "<u4").tolist() == [x for r in rows for x in library(r[1])]


def test_only_asked_documents_are_decompressed(spark, tmp_path, library):
    rng = random.Random(2)
    rows = [(3 * i, prose(rng, 100), "en", "s") for i in range(40)]
    path = written(spark, tmp_path, rows, shard_bytes=1500)
    # all other documents' frames are spoilt
    for name in glob.glob(f"{tmp_path}/files/part-*"):
        data = bytearray(open(name, "rb").read())
        file = token_files.TokenFile(bytes(data))
        for i, doc_id in enumerate(file.ids.to_pylist()):
            if doc_id not in (30, 90):
                data[file.offsets[file.first[i]] + 9] ^= 255
        open(name, "wb").write(bytes(data))
        hidden = name.rsplit("/", 1)[0] + "/." + name.rsplit("/", 1)[1] + ".crc"
        os.path.exists(hidden) and os.remove(hidden)  # the file system's own checksum
    got = {r.doc_id: (r.start, r.ids) for r in token_files.read_token_files(spark, path, ids=[30, 90, 31]).collect()}
    starts = np.cumsum([0, *[len(library(r[1])) for r in rows]])
    assert got == {i: (starts[i // 3], library(dict((r[0], r[1]) for r in rows)[i])) for i in (30, 90)}
    with pytest.raises(Exception, match="checksum|decompressed"):
        token_files.read_token_files(spark, path).collect()
    assert token_files.read_token_files(spark, path, ids=[]).count() == 0


def test_long_documents_have_several_frames(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 7)
    shard = token_files.Shard(0, 0)
    compressor = zstandard.ZstdCompressor()
    for i, n in enumerate((0, 1, 7, 8, 30)):
        shard.add(i, np.arange(n, dtype="<u4"), compressor)
    file = token_files.TokenFile(shard.unclosed(compressor) + token_files.LINE_END.encode("latin-1"))
    assert [np.frombuffer(file.document(i), "<u4").tolist() for i in range(5)] == [list(range(n)) for n in (0, 1, 7, 8, 30)]
    assert file.starts.tolist() == [0, 0, 1, 8, 16] and np.diff(file.first).tolist() == [1, 1, 1, 2, 5]


def test_an_empty_table_and_files_of_others(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert token_files.read_token_files(spark, path).count() == 0
    for data in (b"", b"short", b"x" * 100):
        with pytest.raises(ValueError, match="seek table"):
            token_files.TokenFile(data)


def test_one_id_of_many_rows_is_dealt_to_several_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None if i % 3 else i, prose(rng, 20), "en", "s") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = written(spark, tmp_path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    facts = token_files.token_file_facts(spark, path).collect()
    assert sum(f.first_id is None for f in facts) >= 2 and sum(f.n_docs for f in facts) == 600


def test_words_of_all_kinds_equal_the_library(library, monkeypatch):
    """Words that are encoded many at a time, with the words kept and forgotten."""
    rng = random.Random(4)
    alphabet = "aeghstxyzABE'.,!-/<|>\x01\x1c\u00e9e\u0301\u0338=\u00df\u0130\u65e51\u00bd_ \t\n\u00a0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["it's we'll. don't,", "a<|endoftext|>b.", "<|ENDOFTEXT|>x."]
    for room in (1 << 18, 10):
        monkeypatch.setattr(token_files, "KEPT_WORDS", room)
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            assert [x.tolist() for x in token_files._encoded(pa.array(part), SPEC)] == [library(t)[:-1] for t in part]
