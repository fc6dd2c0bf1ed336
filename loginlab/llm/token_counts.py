"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is compiled, transition by transition as texts need them, into a
deterministic transducer over characters. Each transition carries the change in the number of
tokens; the sum over a text is the text's token count. Long texts are cut into chunks. A chunk's
state map says what the chunk does to any state; state maps compose associatively, so those of
one text are combined by a prefix scan in two levels.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows stay repeated. Columns other than
the id and the text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm import chunks
from loginlab.llm.common import SEGMENT, TOKENIZER_FOLDER, WHITE, per_process, table

CHUNK = 32768  # characters
FAN_IN = 64  # chunk maps combined at the first level of the scan
MOST_ROWS = 250_000  # states kept by one process before the transducer starts afresh
MOST_PATHS = 400_000  # segments whose path through the transducer one process remembers


class Merges:
    """The merge rules of a byte-level BPE file, with the test that decides whether two
    tokens stay apart when they stand next to each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = _byte_of_letter()
        raw = lambda s: bytes(plain[c] for c in s)
        vocabulary = {raw(k): v for k, v in model["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(model["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            key = vocabulary[a], vocabulary[b]
            self.rank[key] = n
            self.parts.setdefault(vocabulary[a + b], (*key, n))
        self.special = [t["content"] for t in model.get("added_tokens", []) if t["special"]]
        # a trie of the tokens; node * 256 + byte leads to the next node
        self.next: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]  # a longer token goes on
        for word, token in sorted(vocabulary.items()):
            node = 0
            for b in word:
                self.inner[node] = True
                node = self.next.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = token

    def apart(self, x: int, y: int) -> bool:
        """True if x followed by y is how BPE leaves their bytes. Going back in time from
        the finished pair, undo the later of the two last merges; the pair that was adjacent
        before must not have had a merge of its own that came first."""
        x_ends = y_ends = len(self.rank)
        while True:
            cross = self.rank.get((x, y))
            if cross is not None and cross < x_ends and cross <= y_ends:
                return False
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                return True
            if py is None or (px is not None and px[2] > py[2]):
                x, x_ends = px[1], px[2]
            else:
                y, y_ends = py[0], py[2]


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write a byte that is no printable Latin-1 character as a letter
    from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


# The merges inside an open pre-token are a flat tuple: for each suffix that may begin a longer
# token, longest first, its node in the trie, the last token before it (-1: none) and the
# number of tokens since.
EMPTY = (0, -1, 0)


class Paths(dict):
    """Tokens on the way from the start state through a segment."""

    def __init__(self, machine):
        self.machine = machine

    def __missing__(self, segment):
        if len(self) > MOST_PATHS:
            self.clear()
        n = self[segment] = self.machine.run(self.machine.start, segment)[1]
        return n


FIRST_SYNC = re.compile(f"[^{WHITE}](?=[{WHITE}])")


class Transducer:
    """Counts how many tokens a text has, were it to end after each character.

    A state consists of the pre-tokenizer's mode, the state of the merges inside the open
    pre-token, and, while the beginning of a special token has been read, the state before it.
    ``rows`` has a dictionary per state, from character to ⟨next dictionary, change⟩; under None
    it holds the state itself. The table starts afresh once it has ``MOST_ROWS`` states.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.merges = Merges(path)
        self.kinds: dict[str, str] = {}
        self.paths = Paths(self)
        if len(self.merges.special) > 1 or any(s.count(s[0]) > 1 for s in self.merges.special):
            raise ValueError("more than one special token, or one that overlaps itself")
        self.special = (self.merges.special or [""])[0]
        self.clear()

    def clear(self):
        self.rows: dict = {}
        self.start = self.row((("S",), 0, None, 0))

    def row(self, state) -> dict:
        found = self.rows.get(state)
        if found is None:
            found = self.rows[state] = {None: state}
        return found

    # -- merges ---------------------------------------------------------------------------

    def feed(self, at: tuple, text: str):
        """The merges after more characters, and the change in tokens."""
        merges = self.merges
        follow, tokens, inner = merges.next, merges.token, merges.inner
        total = 0
        for b in text.encode("utf-8"):
            kept, ends = [], -1
            for i in range(0, len(at), 3):
                node = follow.get(at[i] << 8 | b)
                if node is None:
                    continue
                last = at[i + 1]
                if ends < 0:
                    token = tokens[node]
                    if token >= 0 and (last < 0 or merges.apart(last, token)):
                        ends, change = token, 1 - at[i + 2]
                if inner[node]:
                    kept.append((node, last, at[i + 2]))
            if ends < 0:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            at = (*[x for node, last, since in kept for x in (node, last, since + change)], 0, ends, 0)
            total += change
        return at, total

    # -- pre-tokenizer --------------------------------------------------------------------

    def kind(self, ch: str) -> str:
        """L letter, N number, O other, W white space, as the library's pre-tokenizer sees it."""
        found = self.kinds.get(ch)
        if found is None:
            one = lambda s: len(self.library.pre_tokenize_str(s)) == 1
            found = "L" if one("a" + ch) else "N" if one("1" + ch) else "O" if one("!" + ch) else "W"
            self.kinds[ch] = found
        return found

    def opens(self, ch: str):
        """ch begins a pre-token."""
        kind = self.kind(ch)
        if ch == "'":
            return ("A",), self.feed(EMPTY, ch)[1]
        p, n = self.feed(EMPTY, ch)
        return ("W", p, -n, ch) if kind == "W" else (kind, p), n

    def mode(self, mode, ch: str):
        """The next mode, and the change in tokens."""
        name, kind = mode[0], self.kind(ch)
        if name == "S":
            return self.opens(ch)
        if name == "W":
            _, p, without_last, last = mode
            if kind == "W":
                p, n = self.feed(p, ch)
                return ("W", p, -n, ch), n
            if last == " ":
                p, n = self.feed(EMPTY, " " + ch)
                return (kind, p), without_last + n
            new, n = self.opens(ch)
            return new, without_last + self.feed(EMPTY, last)[1] + n
        if name == "A":
            if ch in ("s", "t", "m", "d"):
                return ("S",), self.feed(EMPTY, "'" + ch)[1] - 1
            if ch in ("r", "v", "l"):
                p, n = self.feed(EMPTY, ch)
                return ("B", p, ch), n
            if kind == "O":
                p, n = self.feed(EMPTY, "'" + ch)
                return ("O", p), n - 1
            return self.opens(ch)
        if name == "B":
            _, p, first = mode
            if first + ch in ("re", "ve", "ll"):
                return ("S",), self.feed(EMPTY, "'" + first + ch)[1] - 1 - self.feed(EMPTY, first)[1]
            name, mode = "L", ("L", p)
        if kind == name:
            p, n = self.feed(mode[1], ch)
            return (name, p), n
        return self.opens(ch)

    def transition(self, row: dict, ch: str):
        mode, matched, before, since = row[None]
        new, change = self.mode(mode, ch)
        out = change
        if self.special:
            if ch == self.special[matched]:
                before, since = (before, since + change) if matched else (mode, change)
                matched += 1
                if matched == len(self.special):
                    new, out = ("S",), change - since + 1
                    matched, before, since = 0, None, 0
            elif ch == self.special[0]:
                matched, before, since = 1, mode, change
            else:
                matched, before, since = 0, None, 0
        found = row[ch] = self.row((new, matched, before, since)), out
        return found

    # -- texts ----------------------------------------------------------------------------

    def run(self, row: dict, text: str):
        n = 0
        for ch in text:
            try:
                row, change = row[ch]
            except KeyError:
                row, change = self.transition(row, ch)
            n += change
        return row, n

    def count(self, text: str) -> int:
        if len(self.rows) > MOST_ROWS:
            self.clear()
        return sum(map(self.paths.__getitem__, SEGMENT.findall(text)))

    def state_map(self, text: str):
        """⟨head, count, end⟩. White space after something else begins a pre-token whatever
        came before, so the part from the first such place on has one outcome; the head before
        it is run from the state that the chunk is entered with. Without such a place the whole
        chunk is head and ``end`` is None."""
        if len(self.rows) > MOST_ROWS:
            self.clear()
        found = FIRST_SYNC.search(text)
        if not found:
            return text, 0, None
        at = found.end()
        segments = SEGMENT.findall(text, at)
        row, n = self.run(self.start, segments[-1])
        return text[:at], n + sum(map(self.paths.__getitem__, segments[:-1])), pickle.dumps(row[None])

    def compose(self, a, b):
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        row, n = self.run(self.row(pickle.loads(a[2])), b[0])
        if b[2] is None:
            return a[0], a[1] + n, pickle.dumps(row[None])
        return a[0], a[1] + n + b[1], b[2]

    def outcome(self, state_map) -> int:
        head, n, _ = state_map
        return self.run(self.start, head)[1] + n


def _machine(path: str) -> Transducer:
    return per_process(("transducer", path), lambda: Transducer(path))


def count_tokens(docs: DataFrame, path: str, id_col="doc_id", text_col="text", chunk=CHUNK) -> DataFrame:
    """⟨id, n_bytes, n_tokens⟩ per row of ``docs``. Texts up to ``chunk`` characters are counted
    where they are read; of longer ones the chunks are dealt out and their maps combined."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    short = rows.where(F.octet_length("text") <= chunk)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in batches:
            n = [machine.count(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_bytes"], pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    out = f"id {kind}, n_bytes long, n_tokens long"
    counted = short.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, out)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in batches:
            found = [machine.state_map(t.as_py()) for t in batch["chunk"]]
            columns = [[x[k] for x in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("id", "row_key", "copies", "pos", "n_bytes")),
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.binary()),
                ],
                ["id", "row_key", "copies", "pos", "n_bytes", "head", "n", "end"],
            )

    fields = f"id {kind}, row_key binary, copies long, pos int, n_bytes long, head string, n long, end binary"

    def scan(group):
        machine = _machine(path)
        group = group.sort_values("pos")
        total = ("", 0, None)
        for x in zip(group["head"], group["n"], group["end"]):
            end = None if x[2] is None else bytes(x[2])
            total = machine.compose(total, (x[0], int(x[1]), end))
        first = group.iloc[:1].copy()
        first["n_bytes"] = group["n_bytes"].sum()
        first["head"], first["n"] = total[0], total[1]
        first["end"] = [total[2]]
        return first

    def last(group):
        out = scan(group)
        out["n"] = _machine(path).outcome((out["head"].iloc[0], int(out["n"].iloc[0]), out["end"].iloc[0]))
        return out

    pieces = chunks.deal(rows.where(F.octet_length("text") > chunk), chunk)
    mapped = pieces.mapInArrow(maps, fields)
    level = mapped.groupBy("id", "row_key", (F.col("pos") / FAN_IN).cast("int").alias("block"))
    level = level.applyInPandas(lambda g: scan(g), fields)
    whole = level.groupBy("id", "row_key").applyInPandas(last, fields)
    long_ = whole.select("id", "n_bytes", F.col("n").alias("n_tokens"), "copies")
    long_ = long_.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
    return counted.unionByName(long_).withColumnRenamed("id", id_col)


LIMIT = 512


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZER_FOLDER}/byte_bpe_50k.json")
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
