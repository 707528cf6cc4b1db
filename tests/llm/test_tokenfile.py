import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tagloom.llm.common import scratch
from tagloom.llm.tokenfile import SplitTokenizer, read_token_files, sequence, token_files, write_token_files

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def by_hand(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, docs, rows):
    got = [tuple(r) for r in token_files(docs.repartition(5), PATH, width=256).orderBy("start").collect()]
    assert got == by_hand([(r.doc_id, r.text) for r in rows])


def test_pieces_are_the_whole(rows):
    odd = ["", "a <|endoftext|> b<|endoftext|>c", " İstanbul ΑΣ x\x0by é é ́a don't I'LL 12½３ ", "a b  \n", "\u0085x", "naïve%%% Straße*** ÇA,ça", "«q» word||| 'S 's", "ﬁ Ⅷ ①²", "a\x1cb \x1d c", "a\u00a0b\u2003c\x0bd"]
    s, t = SplitTokenizer(PATH), Tokenizer.from_file(PATH)
    assert s.by_piece and s.plain
    for text in [*odd, *(r.text or "" for r in rows)]:
        assert s.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    s, t = SplitTokenizer(path), Tokenizer.from_file(path)
    assert not s.by_piece
    assert s.encode("two  spaces\nand lines").tolist() == t.encode("two  spaces\nand lines", add_special_tokens=False).ids


def test_sequences_and_masks(spark, docs, rows):
    folder = scratch(spark, "test-tokens")
    shards = write_token_files(docs, folder, PATH, width=100)
    t = Tokenizer.from_file(PATH)
    whole = [i for r in sorted(rows, key=lambda r: r.doc_id) for i in [*t.encode(r.text or "", add_special_tokens=False).ids, 1]]
    at = 0
    for shard, n in shards:
        for row in range(-(-n // 100)):
            ids, mask = sequence(folder, shard, row)
            assert len(ids) == len(mask) == 100 and ids.dtype == np.uint16
            assert ids[mask].tolist() == whole[at : at + mask.sum()] and not ids[~mask].any()
            at += int(mask.sum())
    assert at == len(whole) == sum(n for _, n in shards)
    assert read_token_files(spark, folder, shards).count() == len(rows)


def test_odd_rows(odd, none):
    got = [tuple(r) for r in token_files(odd, PATH, width=64).orderBy("start").collect()]
    want = by_hand([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert got == want
    assert token_files(none, PATH).count() == 0


def test_plain_pieces_and_the_end():
    """Pieces of ASCII letters and marks skip the pattern; the end comes with the text's ids."""
    s, t = SplitTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in ("Word", "word.", "WORD!?*", "a", ".", "&", "x|y", "|", "Word,word", "wordé.", "it's;", "q1.", ""):
        assert s.encode(text, np.array([1], s.kind).tobytes()).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_a_tokenizer_is_kept_until_its_file_changes(tmp_path):
    import os
    import shutil

    from tagloom.llm.tokenfile import kept

    path = str(shutil.copy(PATH, tmp_path / "t.json"))
    one = kept(path)
    one.encode("word word.")
    assert kept(path) is one and "word." in one
    os.utime(path, (1, 1))
    assert kept(path) is not one


def test_it_is_kept_where_the_package_is_not(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tagloom.llm.tokenfile import kept

    (tmp_path / "f").write_bytes(cloudpickle.dumps(kept))
    code = "import pickle, sys; a, b = (pickle.load(open('f', 'rb')) for _ in range(2)); print(a is not b and a(sys.argv[1]) is b(sys.argv[1]), 'tagloom' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code, PATH], cwd=tmp_path, env={}, capture_output=True, text=True, timeout=60)
    assert done.stdout.split() == ["True", "False"], done.stderr
