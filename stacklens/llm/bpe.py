"""Byte-pair encoding as a deterministic automaton over tokens, and decoding by its arc labels.

Each merge (u, v) -> w is a gadget that changes the automaton built so far: the arc with label v that
leaves the state after u goes; a new label w enters the state after w from every state that had an arc u,
and that state leaves as the state after v did. Composing all gadgets in order of rank gives an automaton
that accepts exactly the token sequences the merges produce: one per byte string, and each prefix of it is
again one. So a state is known by the last label, and the arc (q, x) exists or not by the gadgets alone:
``Automaton.arc`` settles it by undoing gadgets, latest first, and the answer is kept in the transition
table, so the table holds what texts use instead of all 50,000 x 50,000 entries.

A word is encoded by one pass over its bytes: from each reached place, follow the trie of labels, and take
the arcs that the table allows; each place is reached by exactly one of them. Texts are split by the
vocabulary's pattern first, and special strings are cut out before that.

Defined results: null texts are empty and have no token; null or repeated ids keep their rows; texts of any
length are encoded whole; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stacklens.llm.common import texts

TOKENIZER = "byte_bpe_50k.json"
#: Words of the younger half of a worker's word table, and entries of its arc table; only memory and speed depend on them.
KEEP_WORDS, KEEP_ARCS = 200_000, 3_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Labels of words: a word not met yet is taken from an older table or walked."""

    def __init__(self, walk, older: dict):
        super().__init__()
        self.walk, self.older = walk, dict(older)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self[piece] = self.older.get(piece) or self.walk(piece.encode())
        return found


class Automaton:
    """Compiled from the text of a tokenizer file with a byte-level BPE model."""

    def __init__(self, definition: str, pattern: str):
        spec = json.loads(definition)
        to_byte, vocab = _alphabet(), spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.labels = [b""] * size
        for piece, i in vocab.items():
            self.labels[i] = bytes(map(to_byte.get, piece))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(pattern).findall
        self.decimal = list(map(str, range(size)))
        # gadgets: w's rank, u and v; labels without one are bytes
        self.rank, self.left, self.right, self.gadget = [-1] * size, [0] * size, [0] * size, {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if (u, v) not in self.gadget:
                self.gadget[u, v] = k
                if self.rank[w] < 0:
                    self.rank[w], self.left[w], self.right[w] = k, u, v
        # a trie of labels, one dict from byte to (label or -1, next node) for each node
        self.trie: dict = {}
        for i, label in enumerate(self.labels):
            if label and i not in self.special.values():
                node = self.trie
                for byte in label[:-1]:
                    node = node.setdefault(byte, [-1, {}])[1]
                node.setdefault(label[-1], [-1, {}])[0] = i
        self.size, self.table = size, {}
        self.words = _Words(self.word, {})

    def arc(self, q: int, x: int) -> bool:
        """Whether label x may follow label q: undo the gadgets of both, the latest first.

        At each stage the pair must not be one that a gadget joins before the younger of the two came to be.
        Undoing q leaves its right part, undoing x its left one; (u, u) is joined before x's own gadget, so
        what precedes a new label must already lack the arc that the label's gadget took.
        """
        rank, gadget = self.rank, self.gadget
        until = len(gadget) + len(self.labels)
        while True:
            k = gadget.get((q, x))
            if k is not None and k < until:
                return False
            rq, rx = rank[q], rank[x]
            if rq < 0 and rx < 0:
                return True
            if rq > rx:
                # q came last: it leaves as its right part did before q's gadget
                until, q = rq, self.right[q]
            else:
                # x came last: it is entered where its left part was once its own gadget had acted
                until, x = rx + 1, self.left[x]

    def word(self, data: bytes) -> tuple[int, ...]:
        """The labels of one word's accepting path.

        Only one path leads from the start to any place, so labels are tried from the longest on, and a place from
        which no path reaches the end is not entered again.
        """
        table, trie, size, n = self.table, self.trie, self.size, len(data)
        if len(table) > KEEP_ARCS:
            table.clear()
        out: list[int] = []
        back: list[tuple] = []
        dead: set[int] = set()
        i, q, fits = 0, -2, None
        while i < n:
            if fits is None:
                fits, node, j = [], trie, i
                while j < n:
                    step = node.get(data[j])
                    if step is None:
                        break
                    x, node = step
                    j += 1
                    if x >= 0:
                        fits.append((x, j))
            base = q * size
            while fits:
                x, j = fits.pop()
                if j not in dead:
                    if q == -2:
                        break
                    ok = table.get(base + x)
                    if ok is None:
                        ok = table[base + x] = self.arc(q, x)
                    if ok:
                        break
            else:
                dead.add(i)
                i, q, fits = back.pop()
                out.pop()
                continue
            back.append((i, q, fits))
            out.append(x)
            i, q, fits = j, x, None
        return tuple(out)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        if len(self.words) > KEEP_WORDS:
            # words that were not met since the last change of halves go
            self.words = _Words(self.word, self.words)
        return list(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self._plain(text)))
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else chain.from_iterable(self._plain(part))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_COMPILED: dict[str, Automaton] = {}


def compiled(definition: str, pattern: str) -> Automaton:
    """The automaton of a definition, compiled once in a worker."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Automaton(definition, pattern)
    return _COMPILED[key]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  with_ids: bool = True) -> DataFrame:
    """doc_id, ``ids``, ``decoded``, ``n_tokens`` and digests; ids and decoded text only if asked for."""
    import public_tokenizers

    with open(path or tokenizer_path(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    pattern = public_tokenizers.PATTERN

    def run(batches):
        automaton = compiled(definition.value, pattern)
        for b in batches:
            for part in range(0, b.num_rows, 500):
                piece = b.slice(part, 500)
                rows: list[tuple] = []
                for text in piece.column(1).to_pylist():
                    ids = automaton.encode(text)
                    decoded = automaton.decode(ids)
                    rows.append((ids if with_ids else None, decoded if with_ids else None, len(ids),
                                 hashlib.sha256(",".join(map(automaton.decimal.__getitem__, ids)).encode()).hexdigest(),
                                 hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
                ids, decoded, n, a, c = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()),
                     pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())],
                    ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(docs: DataFrame) -> DataFrame:
    return encode_column(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
