"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts with one state and an arc for every byte.
The merges are compiled in rank order. The gadget of a merge (u, v) lets the new
token uv leave every state that u leaves, gives it the state of v, and cuts the
arc v after u, since the two would have been merged; for u = v it also cuts uv
after u, since equal tokens merge from the left. A sequence of tokens is
accepted just if it is the encoding of its text, so each text has one path.

A state is the last token read. Arcs are resolved by walking the gadgets back
from the younger token to its part at the seam, and the rows of the transition
table are filled when first used: all of it would have billions of entries.
"""

from __future__ import annotations

import array
import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, giving_back, text_bytes

#: Distinct words, and pieces between spaces, whose encoding a worker remembers; memory bounds, not limits of the result.
REMEMBERED_WORDS = 60_000
REMEMBERED_PIECES = 120_000
#: Longer pieces are encoded but not remembered.
REMEMBERED_LENGTH = 64

#: Fixed value: the split of text into words before merging, with white space as the tokenizers library takes it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The deterministic automaton over tokens, with the arcs' labels (ids and bytes)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        as_byte = byte_characters()
        id_of = {bytes(as_byte[c] for c in token): number for token, number in model["vocab"].items() if all(c in as_byte for c in token)}
        self.text_of = {token: f"{number}," for token, number in id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = {number: token for token, number in id_of.items()} | {number: content.encode() for content, number in self.special.items()}
        self.label_of = {str(number): label for number, label in labels.items()}
        shared = {token: token for token in id_of}  # one object per token, whatever table holds it
        self.born: dict[bytes, int] = {bytes([b]): -1 for b in range(256)}
        self.left: dict[bytes, bytes] = {}
        self.right: dict[bytes, bytes] = {}
        self.cut: dict[tuple[bytes, bytes], int] = {}
        self.rows: dict[bytes, dict[bytes, bool]] = {}
        for rank, pair in enumerate(model["merges"]):
            u, v = (bytes(as_byte[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            self._gadget(shared.get(u, u), shared.get(v, v), shared.get(u + v, u + v), rank)
        self._tables()

    def _tables(self) -> None:
        """Byte transitions: each node is a prefix of some label; its labels are those that end there, longest first."""
        step: dict[int, int] = {}
        self.step = step  # node * 256 + byte -> node
        self.fail = array.array("i", [0])
        own: list[bytes | None] = [None]
        layer: list[tuple[int, int]] = []  # (entry, node), by depth
        for label in sorted(self.born, key=len):
            node = 0
            for byte in label:
                entry = node * 256 + byte
                node = step.get(entry, -1)
                if node < 0:
                    node = step[entry] = len(own)
                    own.append(None)
                    self.fail.append(0)
                    layer.append((entry, node))
            own[node] = label
        # a node's parent comes before it, and nodes that end in it are deeper: labels sorted by length give that order
        self.ending: list[tuple[bytes, ...]] = [()] * len(own)
        depth = array.array("i", [0] * len(own))
        for entry, node in layer:
            depth[node] = depth[entry >> 8] + 1
        for entry, node in sorted(layer, key=lambda x: depth[x[1]]):
            parent, byte = entry >> 8, entry & 255
            if parent:
                back = self.fail[parent]
                while back and back * 256 + byte not in step:
                    back = self.fail[back]
                self.fail[node] = step.get(back * 256 + byte, 0)
            self.ending[node] = ((own[node],) if own[node] else ()) + self.ending[self.fail[node]]

    def _fall(self, node: int, byte: int) -> int:
        """The transition where no label goes on; written into the table."""
        back = self.fail[node]
        while back and back * 256 + byte not in self.step:
            back = self.fail[back]
        found = self.step[node * 256 + byte] = self.step.get(back * 256 + byte, 0)
        return found

    def _gadget(self, u: bytes, v: bytes, made: bytes, rank: int) -> None:
        self.cut[(u, v)] = rank
        if made not in self.born:
            self.born[made], self.left[made], self.right[made] = rank, u, v

    def arc(self, state: bytes, token: bytes) -> bool:
        """Whether ``token`` may follow ``state``; b"" is the start."""
        row = self.rows.setdefault(state, {})
        known = row.get(token)
        if known is None:
            if state:
                known = self.arc(b"", token) and self._meet(state, token, len(self.cut) + len(self.born))
            else:  # a token is read at all only if its two parts could meet when it was made
                rank = self.born[token]
                u, v = self.left.get(token, token), self.right.get(token, token)
                known = rank < 0 or (self.arc(b"", u) and self.arc(b"", v) and self._meet(u, v, rank))
            row[token] = known
        return known

    def _meet(self, t: bytes, w: bytes, now: int) -> bool:
        """Whether ``w`` could follow ``t`` before merge ``now``."""
        while True:
            gone = self.cut.get((t, w))
            if gone is not None and gone < now:
                return False
            a, b = self.born[t], self.born[w]
            if a < 0 and b < 0:
                return True
            now = max(a, b)
            if a == b:
                t, w = self.right[t], self.left[w]
            elif a > b:
                t = self.right[t]
            elif self.left[w] == t and self.right[w] == t:
                return False
            else:
                w = self.left[w]

    def encode_sorted(self, words: list[bytes]) -> Iterator[str]:
        """Ids of each word, each followed by a comma, along the one accepted path that spells it.

        The state after a prefix does not depend on what follows, so sorted
        words share the states of their common prefixes.
        """
        rows, arc, step, text_of = self.rows, self.arc, self.step, self.text_of
        before, states, nodes = b"", [b""], [0]  # states[j]: the last token of the first j bytes
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del states[same + 1 :], nodes[same + 1 :]
            node = nodes[-1]
            for j in range(same + 1, len(word) + 1):
                byte = word[j - 1]
                node = step.get(node * 256 + byte, -1)
                if node < 0:
                    node = self._fall(nodes[-1], byte)
                nodes.append(node)
                for token in self.ending[node]:
                    state = states[j - len(token)]
                    may = rows[state].get(token) if state in rows else None
                    if may is None:
                        may = arc(state, token)
                    if may:
                        states.append(token)
                        break
            path, at = [], len(word)
            while at:
                token = states[at]
                path.append(text_of[token])
                at -= len(token)
            yield "".join(path[::-1])
            before = word

    def emit(self, ids: str) -> str:
        """The labels of the arcs with these ids, read as UTF-8; broken sequences become replacement characters."""
        return b"".join(map(self.label_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


class Encoder:
    """Splits text into words and runs each through the automaton.

    A word never goes on past white space, so a text can be cut wherever white
    space begins. The pieces between single spaces are looked up whole; the ids
    that the automaton gave for them are remembered.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        self.automaton = MergeAutomaton(spec)
        self.split = regex.compile(SPLIT)
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def learn(self, texts: list[str]) -> list[str]:
        """Run the automaton on every unknown piece of the texts at once; returns the pieces to forget."""
        missing: set[str] = set()
        for text in texts:
            missing.update(text.split(" "))
        pieces, known = self.pieces, self.words
        missing = {p for p in missing if p not in pieces and len(p) <= REMEMBERED_LENGTH and p and not p[-1].isspace()}
        findall = self.split.findall
        cuts = [findall(f" {p}") for p in missing]
        order = sorted({w for ws in cuts for w in ws if w not in known})
        fresh = dict(zip(order, self.automaton.encode_sorted([w.encode("utf-8", "surrogatepass") for w in order])))
        known |= fresh
        pieces.update((p, known[ws[0]] if len(ws) == 1 else "".join([known[w] for w in ws])) for p, ws in zip(missing, cuts))
        if len(known) > REMEMBERED_WORDS:
            for word in order:
                del known[word]
        return list(missing) if len(pieces) > REMEMBERED_PIECES else []

    def forget(self, pieces: list[str]) -> None:
        for piece in pieces:
            del self.pieces[piece]

    def _run(self, text: str) -> str:
        words = self.split.findall(text)
        return "".join([self.words.get(w) or next(self.automaton.encode_sorted([w.encode("utf-8", "surrogatepass")])) for w in words])

    def _plain(self, text: str, out: list[str]) -> None:
        head, *pieces = text.split(" ")
        found = list(map(self.pieces.get, pieces))
        open_ = head
        if head and not head[-1].isspace():
            out.append(self._run(head))
            open_ = ""
        if not open_ and None not in found:
            out += found
            return
        # pieces that are empty or end in white space join the next one
        for piece, got in zip(pieces, found):
            if got is not None and not open_:
                out.append(got)
                continue
            whole = f"{open_} {piece}"
            if piece and not piece[-1].isspace():
                out.append(self._run(whole))
                open_ = ""
            else:
                open_ = whole
        if open_:
            out.append(self._run(open_))

    def run(self, text: str) -> str:
        """The ids as decimals joined by commas."""
        out: list[str] = []
        if self.added is None or not any(x in text for x in self.automaton.special):
            self._plain(text, out)
        else:
            for part in self.added.split(text):
                number = self.automaton.special.get(part)
                if number is None:
                    self._plain(part, out)
                else:
                    out.append(f"{number},")
        return "".join(out)[:-1]

    def encode(self, text: str) -> list[int]:
        ids = self.run(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        return self.automaton.emit(",".join(map(str, ids)))


_HELD: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The compiled encoder of a tokenizer file's text; one per worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(spec)
        give_back()
        gc.freeze()  # the collector need not walk the tables
    return _HELD[key]


def _lists(rows: tuple[np.ndarray, ...]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (if asked for), ids_sha256, decoded, decoded_sha256.

    ``tokenizer`` is the path of a byte-level BPE file on the driver; its text
    (a few MB) travels with the tasks. Null and empty texts have no tokens.
    Added tokens in a text are taken as such, as the tokenizers library does.
    Rows are independent of each other, so repeated rows and ids stay as they
    are; extra columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    types = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    types += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(spec.value)
        for rows in batches:
            _, offsets = text_bytes(rows.column(1))
            for first, last in chunks(offsets):
                part = rows.slice(first, last - first)
                texts = [text or "" for text in part.column(1).to_pylist()]
                fresh = tool.learn(texts)
                out: list[tuple] = []
                for text in texts:
                    found = tool.run(text)
                    back = tool.automaton.emit(found)
                    more = (np.fromstring(found, np.int32, sep=","), back) if ids else ()
                    out.append((found.count(",") + bool(found), hashlib.sha256(found.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), *more))
                tool.forget(fresh)
                columns = [_lists(c) if n == "ids" else pa.array(c, t) for c, (n, t) in zip(zip(*out), types[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[n for n, _ in types])
        tool.words.clear()
        tool.pieces.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(giving_back(run), schema)
