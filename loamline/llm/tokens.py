"""Token counts of whole texts with a byte-level BPE vocabulary, by the whole-token shortcut.

The library cuts a text into pre-tokens and merges each of them for itself, so a pre-token's tokens do not depend on
its neighbours. Before the job, every vocabulary string is handed to the merge model alone; those that come back as one
token are proven: wherever such a string is a whole pre-token, it is one token. Texts are then cut into pre-tokens, the
proven ones count as one and only the rest are merged, each once for as long as a worker remembers it.

Pre-tokens are cut with the vocabulary's public pattern. Its classes (letters, digits, white space) hang on the Unicode
version, so the driver also proves that the pattern and the library's own cutter agree on every character below
``PROVEN``; a text with any other character is cut by the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamline.llm.shared import small_batches

PROVEN = 0x300
PIECE = 1 << 20
REMEMBERED = 1 << 19
# A letter before a space before a letter: a pre-token ends here whatever else the text holds.
CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
# The pattern that this kind of vocabulary cuts its texts with: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """The definition of a tokenizer and what was proven of it: ``whole``, the strings of one token."""

    definition: str
    specials: tuple[str, ...]
    whole: tuple[str, ...]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The vocabulary file at ``path`` (readable by the driver only), proven. ValueError if the file does anything to a
        text before the byte-level cut, or has special strings that take their neighbours in."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            definition = file.read()
        parts = json.loads(definition)
        cutter = parts.get("pre_tokenizer") or {}
        added = parts.get("added_tokens") or []
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        if parts.get("normalizer") or not plain or any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"Not a plain byte-level vocabulary: {path}")
        tokenizer = Tokenizer.from_str(definition)
        _prove_pattern(tokenizer)
        specials = tuple(sorted((a["content"] for a in added), key=lambda s: (-len(s), s)))
        back = {letter: byte for byte, letter in enumerate(_letters(tokenizer))}
        whole = []
        for written in tokenizer.get_vocab(with_added_tokens=False):
            text = _text(written, back)
            if text is not None and text not in specials and len(tokenizer.model.tokenize(written)) == 1:
                whole.append(text)
        return cls(definition, specials, tuple(sorted(whole)))


def _letters(tokenizer) -> list[str]:
    """The letter that stands for each byte, read off the library: U+0000 to U+007F for the low half, and the trail and
    lead bytes of two-byte and longer characters for the rest; bytes that no character has get none."""
    from tokenizers.pre_tokenizers import ByteLevel

    cutter, letters = ByteLevel(add_prefix_space=False, use_regex=False), [""] * 256
    for code in [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x10000, 64), *range(0x10000, 0x110000, 4096)]:
        data = chr(code).encode()
        for byte, letter in zip(data, cutter.pre_tokenize_str(chr(code))[0][0]):
            letters[byte] = letter
    return letters


def _text(written: str, back: dict[str, int]) -> str | None:
    try:
        return bytes(back[letter] for letter in written).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def _plain_pattern() -> re.Pattern:
    """``PATTERN`` for characters below ``PROVEN``, with its classes written out."""
    import regex

    letters, digits, spaces = ("".join(f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" for c in range(PROVEN) if regex.match(kind, chr(c)))
                               for kind in (r"\p{L}", r"\p{N}", r"\s"))
    plain = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    return re.compile(plain.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


def _prove_pattern(tokenizer) -> None:
    pattern = _plain_pattern()
    for code in range(PROVEN):
        c = chr(code)
        probe = f"a{c}a 1{c}1 .{c}. {c}  {c}{c} a"
        if pattern.findall(probe) != [probe[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]:
            raise ValueError(f"The pattern and the library cut U+{code:04X} in different ways")


class Counter(dict):
    """Pre-token -> number of tokens; unknown ones are merged and remembered."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.proven = len(self)
        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_str(vocabulary.definition)
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(_letters(self.tokenizer)))
        self.cut = _plain_pattern().findall
        self.plain = re.compile(f"[\\x00-{chr(PROVEN - 1)}]*").fullmatch
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials)) or r"(?!)")

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) >= self.proven + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.vocabulary.whole, 1))
        self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if self.plain(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self.ordinary(text[at:found.start()]) + 1
            at = found.end()
        return total + self.ordinary(text[at:] if at else text)

    def ordinary(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts(text))


def parts(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end where a pre-token ends; longer where there is no such place."""
    at = 0
    while len(text) - at > size:
        place = CUT.search(text, at + size)
        if place is None:
            break
        yield text[at:place.start()]
        at = place.start()
    yield text[at:] if at else text


_COUNTERS: dict[str, Counter] = {}


def _counter(vocabulary: Vocabulary) -> Counter:
    """The worker's counter: one for as long as the worker lives, of the last vocabulary it was asked for."""
    key = f"{hash(vocabulary.definition)}"
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens of the whole text, and over_limit: n_tokens > ``limit``.

    Counts are those of the library without begin, end or added special tokens; a special string inside a text is one
    token, as the library has it. A null text counts as empty: no bytes, no tokens. All rows and columns stay, repeated
    rows too; columns of the three names are replaced. The vocabulary goes to the executors as a broadcast of its file
    (some MB, whatever the input). No shuffle; memory is a batch of 8 MB, or one text where that is longer, the
    pre-tokens of 1 MB of it and 2^19 remembered pre-tokens.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.LongType())
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(shipped.value)
        for texts in batches:
            yield pa.array([0 if t is None else counter.count(t) for t in (x.as_py() for x in texts)], pa.int64())

    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    counted = small_batches(docs).withColumns({"n_bytes": size, "n_tokens": n_tokens("text")})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
