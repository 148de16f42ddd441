"""Fill-in-middle, token alignment and chunked BPE beside plain versions and the libraries themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import alignment, chunk_bpe, middle
from reviewloom.llm.queries import QUERIES, vocabulary
from tests.compare import differences
from tests.conftest import SMALL
from tests.llm.test_operators import HARD

WORD_BPE, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
#: Texts that the three operators might stumble over, beside those of HARD.
ODD = [
    "a\nb\n\nc", "\n", "\n\n\n", "no line feed", "holds <P> itself\nand more\n", "<M>", "half a mark <\nP>\n<S\n>", "éá ́x", "İstanbul İ", "한글 한", "漢字かな\nまじり文゙",
    "<|startoftext|>a<|endoftext|>", "it's we're they'll I'd 'S 'RE", "   \t     ", "▁under▁line", "🙂👩‍💻\n" * 3, "<s> </s> <unk> <0x41>", "0123456789" * 30, "-" * 3000, "z" * 3000, "\u0000nul\r\n", "x" * 20 + "\n" + "y" * 20,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Hard and odd rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t) for i, t, _, _ in HARD] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit("x"), "form": F.lit("y"), "keys": F.lit(1), "ids": F.lit(2), "h1": F.lit(3), "output": F.lit("z"), "links": F.lit(None).cast("double")})


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    """A folder with the hard and odd rows as its documents."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.where("doc_id IS NOT NULL").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# Fill-in-middle


@pytest.mark.parametrize("n", [1, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(n):
    rng = np.random.default_rng(n)
    for density in (0.001, 0.3, 1.0):
        marks = rng.random(n) < density
        bits = middle.BitVector(marks)
        ones = np.flatnonzero(marks)
        assert bits.total == len(ones)
        assert [bits.select(i + 1) for i in range(len(ones))] == ones.tolist()
        for at in {0, 1, n // 2, n - 1, n}:
            assert at == 64 * len(bits.words) or bits.rank(at) == marks[:at].sum()


def plain_middle(doc, text, unit, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc, len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("char", 100, 50), ("line", 40, 0), ("char", 90, 100)])
def test_middle(spark, odd, unit, rate, spm):
    docs = odd.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    made = middle.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(made) == Counter(plain_middle(*r, unit, rate, spm) for r in given)
    again = made.select("doc_id", middle.restored(F.col("output"), F.col("form")))
    assert rows_of(again) == Counter((i, t or "") for i, t in given)
    assert middle.fill_in_middle(odd.limit(0)).count() == 0


def test_middle_gives_the_rows_of_its_sql_on_odd_texts(spark, tables, tmp_path):
    from reviewloom.llm.queries import ORACLE_SQL

    spark.read.parquet(f"{tables}/documents.parquet").toPandas()[["doc_id", "text"]].to_parquet(tmp_path / "documents.parquet")
    assert not differences(QUERIES["op11_fim_select"](spark, str(tmp_path)), ORACLE_SQL["op11_fim_select"], str(tmp_path))


# Alignment


def plain_alignment(texts):
    """All links listed one by one."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    from reviewloom.llm.packing import byte_table

    a, b = Tokenizer.from_file(vocabulary()), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    with open(vocabulary(), encoding="utf-8") as f:
        entries = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    chars = byte_table()
    out, docs = [], Counter()
    for text in texts:
        groups, links = [], Counter()
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_x = [bytes(chars[c] for c in entries[i]) for i in x]
            bytes_y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in y]
            if b"".join(bytes_x) == b"".join(bytes_y) == (" " + text).encode():
                i = j = at_x = at_y = 0
                group = ([], [])
                while i < len(x) or j < len(y):
                    if at_x <= at_y:
                        at_x += len(bytes_x[i])
                        group[0].append(x[i])
                        i += 1
                    else:
                        at_y += len(bytes_y[j])
                        group[1].append(y[j])
                        j += 1
                    if at_x == at_y:
                        groups.append(group)
                        group = ([], [])
        for g in groups:
            links.update((p, q) for p in g[0] for q in g[1])
        docs.update(links.keys())
        out.append((groups, links))
    best = defaultdict(int)
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    for groups, links in out:
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), links.total(), sum(n for k, n in links.items() if docs[k] == best[k[0]]), sum(n * docs[k] for k, n in links.items()), sha(shown) if shown else ""


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("where", ["small", "odd"])
def test_alignment(spark, tables, where):
    folder = SMALL if where == "small" else tables
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_token_alignment"](spark, folder).select(*COLUMNS)) == Counter((i, *x) for (i, _), x in zip(given, plain_alignment([t for _, t in given]), strict=True))


def test_alignment_of_no_rows(spark, odd):
    made = alignment.alignments(odd.limit(0), vocabulary(), PIECES)
    assert alignment.with_pair_counts(made).count() == 0
    made = alignment.alignments(odd.where("text IS NULL OR text = ''"), vocabulary(), PIECES)
    assert {tuple(r)[1:] for r in alignment.with_pair_counts(made).collect()} == {(0, 0, 0, 0, "", 0, 0)}


def test_links_of_a_large_group_are_those_listed_one_by_one():
    rng = np.random.default_rng(4)
    a, b, of_a, of_b = rng.integers(0, 9, 700), rng.integers(0, 7, 500), np.sort(rng.integers(0, 4, 700)), np.sort(rng.integers(0, 4, 500))
    n_a, n_b = np.bincount(of_a), np.bincount(of_b)
    keys, links = alignment.linked(a, b, of_a, n_a, n_b, n_a.cumsum(), n_b.cumsum())
    assert (n_a * n_b > alignment.LISTED_LINKS).any()
    listed = Counter((int(x) << 32) | int(y) for g in range(4) for x in a[of_a == g] for y in b[of_b == g])
    assert dict(zip(keys.tolist(), links.tolist(), strict=True)) == dict(listed)
    assert keys.tolist() == sorted(keys.tolist())


def test_counts_in_many_shards_and_from_a_store(spark, monkeypatch, tmp_path):
    """Keys that many tasks hold, more ranges than keys, flushes in between; shards are copied first where no folder is mounted."""
    monkeypatch.setattr(alignment, "HELD_KEYS", 3)
    rows = [([(i % 5) << 32 | j for j in range(i % 7)],) for i in range(60)]
    aligned = spark.createDataFrame(rows, "keys array<long>").repartition(7)
    counts = alignment.pair_counts(spark, alignment.partial_counts(aligned))
    expected = Counter(k for r in rows for k in r[0])
    keys = np.array(sorted(expected))
    assert counts.of(keys).tolist() == [expected[k] for k in keys.tolist()]
    assert counts.best.tolist() == [max(n for k, n in expected.items() if k >> 32 == a) for a in range(5)]
    monkeypatch.setattr(alignment, "local_path", lambda path: None)
    path = f"file://{tmp_path}/shard"
    alignment.written(path, keys, keys + 1)
    assert (alignment.mapped(path, len(keys)) == np.stack([keys, keys + 1])).all()


# Chunked BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def plain_bpe(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("where", ["small", "odd"])
def test_chunked_bpe(spark, tables, library, where):
    folder = SMALL if where == "small" else tables
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_chunk_bpe"](spark, folder)) == Counter((i, *plain_bpe(library, t)) for i, t in given)


def test_chunked_bpe_on_hard_rows(spark, odd, library):
    made = chunk_bpe.encoded(odd, WORD_BPE, chunk=8)
    got = Counter((r.doc_id, len(r.ids) // 4, sha(bytes(r.ids)), sha(r.decoded)) for r in made.collect())
    assert got == Counter((r.doc_id, *plain_bpe(library, r.text)) for r in odd.select("doc_id", "text").collect())
    assert chunk_bpe.encoded(odd.limit(0), WORD_BPE).count() == 0


@pytest.mark.parametrize("chunk", [2, 4, 16, 64])
def test_joins_are_repaired_wherever_they_fall(library, chunk):
    """Marks, contractions, special tokens, letters that change length and runs of white space across all joins; little is kept."""
    rng, own = random.Random(chunk), chunk_bpe.Encoder(WORD_BPE, chunk, 2000)
    parts = ["a", "b", "the", "'", "s", "'re", " ", "  ", "\n", "\t", "İ", "é", "é", "́", "̀", "한", "한", "ᅡ", "漢", "字", "1", "23", "!", "..", "<|endoftext|>", "<|endof", "text|>", "<|start", "<|startoftext|>", "Σ", "ς", " ", " ", "🙂", "👩‍💻", "ﬁ", "क", "ि", "এ", "া", "ABC", "-"]
    for _ in range(300):
        some = rng.sample(parts, rng.randint(1, len(parts)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 300)))
        ids, decoded = own.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert decoded == library.decode(expected, skip_special_tokens=False)
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(8))})[1:]
        cuts = [c for c in cuts if c == len(text) or chunk_bpe.stands_alone(text[c])]
        assert own._repaired(text, cuts).tolist() == expected, (text, cuts)


def test_shared_passages_are_encoded_once():
    words = [f"word{i} of the passage" for i in range(400)]
    own = chunk_bpe.Encoder(WORD_BPE)
    own.encode("A beginning. " + " ".join(words))
    made = own.made
    own.encode("Quite another beginning of things, " + " ".join(words))
    assert own.made - made < 0.3 * made + 2


@pytest.mark.parametrize("high", [0x250, 0x3000])
def test_common_words_are_split_as_the_library_splits_them(library, high):
    """Each character alone, inside words, digits, signs and contractions, in either case."""
    own = chunk_bpe.Encoder(WORD_BPE)
    for c in map(chr, range(high)):
        text = f"{c} a{c}b 1{c}2 !{c}? {c}{c} 'S{c} it{c}s '{c}re A{c}B {c}"
        expected = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.piece(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected, hex(ord(c))
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_words_are_forgotten_and_encoded_anew(library):
    own = chunk_bpe.Encoder(WORD_BPE, kept_words=5)
    for text in ("one two three four", "five six seven one", "one two three four five six seven eight nine"):
        assert np.frombuffer(own.encode(text)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_depend_on_their_own_characters():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh é漢́") for _ in range(5000))
    ends, more = ([e for e, _ in chunk_bpe.chunk_ends(x, 64)] for x in (text, "xyz" * 30 + text))
    assert {e + 90 for e in ends if e > 100} == {e for e in more if e > 190}
    assert 30 < len(ends) < 160
