import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starmill.llm import token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "  two  blanks ", " lead", "trail ", "a  b", "a  b", "tab\t x", "x\n y", "don't it's we'll",
       "“quoted” “again”", "nul\x00 byte", "日本語 のテキスト ！", "1 2 33 a1 b2", "long " * 9000, "<|endoftext|> x", "é " * 3, "\x1f a", "a.\nB,c é,d\n\né\nf. G's 'x' [(a)] x<|endoftext|>y", "x\n.y a\n", "a\r\nb", "9.9,9-a_b"]


def written(spark, rows, folder, columns="doc_id bigint, text string, shard string, ids int"):
    token_orc.write_tokens(spark.createDataFrame(rows, columns), folder, PATH)
    return token_orc.read_tokens(spark, folder)


def test_ids_are_the_librarys(spark, tmp_path):
    rows = [(k * 7 % 23, text, "x", 1) for k, text in enumerate(ODD)] + [(None, "no id", "x", 1)]
    got = {r.doc_id: r for r in written(spark, rows, f"{tmp_path}/t").collect()}
    library = Tokenizer.from_file(PATH)
    for key, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[key].ids == want, text
        assert got[key].n_tokens == len(want)


def test_digest_counts_on_in_id_order(spark, tmp_path):
    rows = [(k, f"words {k} " * (k % 5), None, None) for k in range(200)] + [(7, "again", None, None)]
    digest = token_orc.digest(written(spark, rows, f"{tmp_path}/t")).collect()
    library, start = Tokenizer.from_file(PATH), 0
    by_start = sorted(digest, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted(k for k, *_ in rows)
    for r in by_start:
        assert r.start == start
        start += r.n_tokens
    texts = {k: t for k, t, *_ in rows if k != 7}
    for r in by_start:
        if r.doc_id != 7:
            ids = library.encode(texts[r.doc_id]).ids + [0]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_empty_table(spark, tmp_path):
    assert token_orc.digest(written(spark, [], f"{tmp_path}/t")).count() == 0


def test_condition_reaches_the_files(spark, tmp_path, plan):
    written(spark, [(k, "some text", "s", 1) for k in range(50)], f"{tmp_path}/t")
    one = token_orc.read_tokens(spark, f"{tmp_path}/t", F.col("doc_id") == 9)
    assert "EqualTo(doc_id,9)" in plan(one)
    assert [r.doc_id for r in one.collect()] == [9]


@pytest.mark.parametrize("text", ["a b", "a  b", "a\n\nb c", "x  ", "　 a"])
def test_pieces_cover_the_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = token_orc._pieces(data, np.array([0, len(data)]))
    assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all()
