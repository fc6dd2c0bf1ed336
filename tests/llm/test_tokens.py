import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from loginlab.llm import byte_bpe, packing, token_counts
from loginlab.llm.common import SEGMENT, TOKENIZER_FOLDER

MULTI = f"{TOKENIZER_FOLDER}/byte_bpe_multi_50k.tiktoken"
BYTES = f"{TOKENIZER_FOLDER}/byte_bpe_50k.json"
WORDS = f"{TOKENIZER_FOLDER}/word_bpe_49k.json"
ODD = "ab  \n\t'SRsrtvelmd1²9é漢　\x1c\x85 <|endoftext|>!?'.́😀"


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, length, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(length))) for _ in range(n)]


def data(ids):
    return np.array(ids, "<u4").tobytes()


def test_segments_keep_the_text():
    for text in odd_texts(500, 40):
        assert "".join(SEGMENT.findall(text)) == text


def test_encoding_is_the_librarys_for_every_character(library):
    codec = byte_bpe.Codec(MULTI, byte_bpe.PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x30000, 7)]:
        text = f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)} "
        assert [m.group() for m in codec.split.finditer(text)] == codec.split.findall(text)
        assert codec.encode(text) == data(library.encode_ordinary(text))


def test_windows_stitch_to_the_librarys_ids(library):
    codec = byte_bpe.Codec(MULTI, byte_bpe.PATTERN)
    r = random.Random(2)
    for text in odd_texts(2000, 200) + ["漢" * 300, "a" * 100 + " b" * 60]:
        want = data(library.encode_ordinary(text))
        size, overlap = r.choice([(8, 6), (16, 8), (20, 19)])
        windows = [text[i : i + size + overlap] for i in range(0, len(text), size)]
        got = codec.stitch([(w, *codec.window(w, size, overlap)) for w in windows], size, overlap)
        assert (got if windows else b"") == want
        assert codec.decode(want) == text.encode()


def test_query_encodes_and_decodes_whole_texts(spark, folder, odd_documents, library):
    got = byte_bpe.op2_byte_bpe(spark, folder).toPandas()
    want = []
    for i, text in odd_documents:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    rows = [(None if x != x else int(x), n, a, b) for x, n, a, b in got.itertuples(index=False)]
    assert Counter(rows) == Counter(want)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (1000, 300)])
def test_chunked_encoding_is_whole(documents, odd_documents, library, chunk, overlap):
    got = byte_bpe.encode(documents, MULTI, chunk=chunk, overlap=overlap).collect()
    want = Counter((i, data(library.encode_ordinary(t or ""))) for i, t in odd_documents)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_transducer_counts_as_the_library():
    library, machine = Tokenizer.from_file(BYTES), token_counts.Transducer(BYTES)
    r = random.Random(3)
    for text in odd_texts(5000, 30) + ["'s<|endoftext|>'re  'll", "a<|endoftext<|endoftext|>|>", "   "]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == want
        a, b = sorted(r.randrange(len(text) + 1) for _ in range(2))
        x, y, z = map(machine.state_map, (text[:a], text[a:b], text[b:]))
        compose = machine.compose
        assert machine.outcome(compose(compose(x, y), z)) == want == machine.outcome(compose(x, compose(y, z)))


def test_transducer_starts_afresh(monkeypatch):
    library, machine = Tokenizer.from_file(BYTES), token_counts.Transducer(BYTES)
    monkeypatch.setattr(token_counts, "MOST_ROWS", 50)
    monkeypatch.setattr(token_counts, "MOST_PATHS", 20)
    for text in odd_texts(300, 60):
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [50, token_counts.CHUNK])
def test_token_counts(documents, odd_documents, chunk):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(documents, BYTES, chunk=chunk).collect()
    want = Counter(
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_documents
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_token_count_query(spark, folder, odd_documents):
    got = token_counts.op7_token_counts(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.count() == len(odd_documents)
    assert got.where("over_limit != (n_tokens > 512)").count() == 0


def test_words_are_encoded_as_by_the_library():
    encoder = packing.WordEncoder(WORDS)
    texts = [f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}{chr(c)}'{chr(c)} 's" for c in range(0x250)]
    for text in texts + odd_texts(2000, 60):
        assert encoder(text) == data(encoder.library.encode(text, add_special_tokens=False).ids)


def test_marks_beside_a_word_do_not_fill_the_memory():
    encoder = packing.WordEncoder(WORDS)
    marks = [".", ",", "&&&", "(", "»", "!?"]
    for text in (f"{a}wörd{b} {a}word{b}'s" for a in marks for b in marks):
        assert encoder(text) == data(encoder.library.encode(text, add_special_tokens=False).ids)
    remembered = [x for x in vars(encoder).values() if isinstance(x, packing.Memory)]
    # the two words, the marks, "'s" and the marks before it
    assert sum(len(x) for x in remembered) <= 3 + 2 * len(marks)


def packed_well(rows, capacity):
    """Sequences are without gaps and no longer than the capacity; how many there are."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_query(spark, folder, odd_documents):
    library = Tokenizer.from_file(WORDS)
    rows = packing.op3_best_fit_packing(spark, folder).collect()
    want, total = Counter(), 0
    for i, text in odd_documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(data(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packed_well(rows, 2048) == -(-total // 2048)


def test_best_fit_fills_as_well_as_one_by_one():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice([7, 64, 512])
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 40) for _ in range(r.randrange(1, 40))}
        rooms, plain = [], 0
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [x for x in rooms if x >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                plain += 1
                rooms.append(capacity - length)
        runs = packing.best_fit(counts, capacity)
        assert sum(x[2] for x in runs) == sum(counts.values())
        assert len({x[4] + k // x[3] for x in runs for k in range(x[2])}) <= plain + 1


def test_packing_splits_a_hot_length_and_keeps_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    pieces = spark.range(300).selectExpr("id AS doc_id", "0 AS piece", "IF(id % 3 = 0, 5, id % 7 + 1) AS length", "'x' AS ids")
    rows = packing.pack(pieces, 16).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300)) and rows[0].ids == "x"
    packed_well(rows, 16)
    with pytest.raises(ValueError):
        packing.pack(pieces, 4)


def test_empty_tables(documents):
    none = documents.where("false")
    assert byte_bpe.decode(byte_bpe.encode(none, MULTI), MULTI).count() == 0
    assert token_counts.count_tokens(none, BYTES).count() == 0
    assert packing.pack_documents(none).count() == 0


def test_remembered_words_are_few_and_the_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 100)
    made = Counter()
    memory = packing.Memory(lambda key: made.update([key]) or key.encode())
    most = 0
    for n in range(5000):
        assert memory["often"] == b"often" and memory[f"once{n}"] == f"once{n}".encode()
        most = max(most, len(memory) + len(memory.older))
    assert made["often"] == 1 and most <= 200
