"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a word, the encoding of every prefix ends in exactly one token. Going
through the word once, an automaton over the vocabulary (a trie whose nodes link
to their longest suffix) gives the tokens that end at each place, longest first.
Such a token is the prefix's last one exactly when it starts the word, or when
it and the last token of what lies before it stay apart if both are encoded
together. The one that passes is stored; following the stored tokens back from
the end gives the ids. Whether two tokens stay apart follows from the merges
that would undo them and is remembered per pair.

Texts are split at white space first. What comes between is normalized and cut by
the vocabulary's word pattern, once for all texts of a slice. Their new words are
encoded in alphabetical order, as the tokens stored for a prefix hold for every
word that starts so. Words are remembered, up to a bounded number of entries. Strings of special tokens inside a text
become their ids. Decoding joins the ids' tokens with a blank, as the vocabulary
file names no decoder. A null text is an empty one and has no ids. Nothing is
shuffled; every text is encoded where it is read, whole, however long. Repeated rows and
null ids are encoded like others; other columns are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.text import id_and_text, pieces

CACHED_WORDS, CACHED_PAIRS = 120_000, 250_000
MARKS = ".,;:!?"
END = "\x00"  # stands for the end-of-word mark inside the automaton; bytes are written as printable characters
_WHITE = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_WHITE}]+")
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class WordPieces:
    """A byte-pair vocabulary with end-of-word marks, read from a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.number = {i: str(i) for i in self.token}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[a + b]
            self.merge[self.vocab[a], self.vocab[b]] = made
            if made not in self.parts:
                self.parts[made], self.rank[made] = (self.vocab[a], self.vocab[b]), rank
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.word = regex.compile(_WORD)
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.lefts, self.n_pairs = {}, 0
        self.remembered = Rendered(self)
        self.root = self.automaton(mark)

    def automaton(self, mark: str) -> Node:
        """The trie of all tokens, linked; returns its root."""
        root = Node()
        for text, i in self.vocab.items():
            if self.whole(i):
                key, node = text[:-len(mark)] + END if text.endswith(mark) else text, root
                for c in key:
                    if c not in node:
                        node[c] = Node()
                    node = node[c]
                self.lefts[i] = Lefts(self, i)
                node.ends = (len(key), i, self.lefts[i]),
        level = list(root.values())
        for node in level:
            node.shorter = root
        while level:
            for node in level:
                for c, child in node.items():
                    # the longest suffix that goes on with this character
                    shorter = node.shorter
                    while shorter is not root and c not in shorter:
                        shorter = shorter.shorter
                    child.shorter = shorter.get(c, root)
                    child.ends += child.shorter.ends
            level = [child for node in level for child in node.values()]
        return root

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        return token not in self.parts or self.apart(*self.parts[token], below=self.rank[token])

    def apart(self, left: int, right: int, below: int = 1 << 62) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when encoded together, by merges ranked lower than ``below``.

        The two are taken apart from their latest merges on. If, at any stage,
        the pieces that meet in the middle would have merged with each other
        before being merged into what they became, the two do not stay apart.
        """
        rank, parts = self.rank, self.parts
        limit = below
        while True:
            made = self.merge.get((left, right))
            if made is not None and rank[made] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # the left one was completed later, until then its last part met the right one
                limit, left = a, parts[left][1]
            else:
                # of equal merges the one further left comes first, and that is the one across the middle
                limit, right = b + 1, parts[right][0]

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word, written in byte characters; words that start alike are best next to each other."""
        nodes, last, start, known = [self.root], [-1], [0], ""
        for word in words:
            word += END
            shared = 0
            for a, b in zip(known, word):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1:], last[shared + 1:], start[shared + 1:]
            node, known = nodes[shared], word
            for end, c in enumerate(word[shared:], shared + 1):
                after = node.get(c)
                while after is None:
                    node = node.shorter
                    after = node.get(c)
                node = after
                for length, token, lefts in node.ends:
                    before = end - length
                    if not before or lefts[last[before]]:
                        break
                else:
                    before, token = 0, -1
                nodes.append(node)
                last.append(token)
                start.append(before)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            yield ids

    def words(self, text: str) -> list[str]:
        """Normalized text without white space, cut by the word pattern."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
            return self.word.findall(text)
        # code points that newer tables assign are symbols here
        shown = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start():m.end()] for m in self.word.finditer(shown)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """What stands between white space, and the special tokens."""
        if not self.special or not self.special.search(text):
            return split(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*split(text[at:m.start()]), m[0]]
            at = m.end()
        return parts + split(text[at:])

    def encode(self, text: str) -> tuple[str, str]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and tokens of whole texts, each joined by a blank."""
        parts = [self.split(t) for t in texts]
        # one word; one word and a mark; cut by the pattern
        plain, marked, cut = {}, {}, {}
        for chunk in set().union(*parts).difference(self.specials):
            text = chunk.lower() if chunk.isascii() else lowered(chunk)
            if text.isalpha():
                plain[chunk] = text
            elif text[-1] in MARKS and text[:-1].isalpha():
                marked[chunk] = text
            else:
                cut[chunk] = self.words(text)
        words = {*plain.values(), *[t[:-1] for t in marked.values()], *MARKS}
        self.remembered.learn(words.union(*cut.values()))
        place = {c: k for k, c in enumerate([*plain, *marked, *cut, *self.specials])}
        places = [list(map(place.__getitem__, p)) for p in parts]
        made = []
        for known, specials in (self.remembered.ids, map(str, self.specials.values())), (self.remembered.tokens, self.specials):
            after = {mark: " " + known[mark] for mark in MARKS}
            shown = [known[t] for t in plain.values()]
            shown += [known[t[:-1]] + after[t[-1]] for t in marked.values()]
            shown += [" ".join(map(known.__getitem__, w)) for w in cut.values()]
            shown += specials
            made.append([" ".join(map(shown.__getitem__, p)) for p in places])
        return list(zip(*made))


class Node(dict):
    """What follows a beginning of tokens, by character; ``ends`` has the tokens that end here, longest first.

    Each token comes with its length and its ``Lefts``; ``shorter`` is the longest suffix that is a node, too.
    """

    __slots__ = ("shorter", "ends")

    def __init__(self):
        self.ends: tuple[tuple[int, int, Lefts], ...] = ()


class Lefts(dict):
    """Whether tokens stay apart from the one token that follows them; those of all tokens are forgotten when full."""

    __slots__ = ("model", "token")

    def __init__(self, model: WordPieces, token: int):
        self.model, self.token = model, token

    def __missing__(self, left: int) -> bool:
        model = self.model
        if model.n_pairs >= CACHED_PAIRS:
            for lefts in model.lefts.values():
                lefts.clear()
            model.n_pairs = 0
        model.n_pairs += 1
        found = self[left] = left >= 0 and model.apart(left, self.token)
        return found


class Rendered:
    """Ids and tokens of words, each joined by a blank.

    When full, all entries become the older ones, which are still looked up and
    go when the next lot is full.
    """

    def __init__(self, model: WordPieces):
        self.model = model
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}

    def learn(self, words: set[str]) -> None:
        """Make all ``words`` known."""
        if len(self.ids) >= CACHED_WORDS:
            self.older, self.ids, self.tokens = (self.ids, self.tokens), {}, {}
        (older_ids, older_tokens), model = self.older, self.model
        new = {}
        for word in words.difference(self.ids):
            if word in older_ids:
                self.ids[word], self.tokens[word] = older_ids[word], older_tokens[word]
            else:
                new[word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(model.characters)] = word
        spelled = sorted(new)
        for word, ids in zip(map(new.__getitem__, spelled), model.encode_words(spelled)):
            self.ids[word], self.tokens[word] = " ".join(map(model.number.__getitem__, ids)), model.decode(ids)


def lowered(text: str) -> str:
    """Normalized and in lower case."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma


def split(text: str) -> list[str]:
    # str.split also splits at four control characters, which the word pattern keeps
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in _SPLIT.split(text) if c]
    return text.split()


class Models(dict):
    """Vocabularies by path; each process reads its own, none is sent along with a task."""

    def __reduce__(self):
        return Models, ()


_models: dict[str | None, WordPieces] = Models()


def vocabulary(path: str | None = None) -> WordPieces:
    if path not in _models:
        import public_tokenizers

        _models[path] = WordPieces(path or public_tokenizers.path("word_bpe_49k.json"))
    return _models[path]


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(tokenizer)
        for batch in batches:
            for part in pieces(batch):
                ids = [[int(i) for i in found.split()] for found, _ in model.encode_all(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` of rows with ``doc_id`` and ``ids``; null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
            with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the encoded and again decoded texts, in one pass.

    With ``with_ids``, also ``ids`` as little-endian 16-bit numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), *([("ids", pa.binary())] if with_ids else [])])

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(tokenizer)
        if with_ids and len(model.token) > 1 << 16:
            raise ValueError("ids are written as 16 bits")
        for batch in batches:
            for part in pieces(batch):
                made = model.encode_all(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in made], pa.int64()),
                           pa.array([digest(ids) for ids, _ in made]), pa.array([digest(text) for _, text in made])]
                if with_ids:
                    columns.append(pa.array([array("H", map(int, ids.split())).tobytes() for ids, _ in made], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return id_and_text(docs, id_column, text_column).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""))
