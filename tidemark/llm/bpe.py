"""BPE encoding and decoding by batched merge rounds over flat numpy arrays.

Texts are normalised and cut into words as the tokenizer file says. The symbols of all
new words of a batch lie in one flat array; each round looks up every neighbouring pair
by binary search over the sorted pair keys, takes the lowest rank of each word, and merges
that pair wherever the word has it. Words that have no pair left leave the array.

Null and empty texts have no ids. Very long words only take more rounds, and long texts more
batches. Repeated rows are encoded alike; of merges with equal rank the left one comes first.
An empty table gives no rows. Only the key and text columns are read, so others cannot clash.
The tokenizer file's path is a parameter; its normaliser must be NFC, white space to one space
and lower case, which is what the fast path does.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Known words are forgotten once there are so many, which bounds a worker's memory.
MAX_KNOWN = 400_000
#: Texts of one flat array: rows are cut into runs of about so many bytes.
RUN_BYTES = 8 << 20
#: Code points that any Unicode version has assigned (planes 0 to 3 and the tags), without surrogates.
ASSIGNED = [*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)]
# Unicode white space.
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _library_regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class Words:
    """Encodings of known chunks (runs without white space) in one flat array, with starts and lengths."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", WHITE).replace(f"[^{WHITE}", f"[^{WHITE}"))
        self.white = regex.compile(f"[{WHITE}]+")
        self.by_library(path)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        n = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [""] * n
        for token, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = token
        spaced = [t.encode() + b" " for t in tokens]
        self.token_len = np.array([len(t) for t in spaced], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(spaced), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * n + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.n, self.keys, self.ranks, self.made = n, keys[order], order, made  # made: by rank
        self.forget()

    def by_library(self, path: str) -> None:
        """Finds the characters that this Python's Unicode tables treat unlike the library's; texts
        with one of them are normalised and split by the library's own steps."""
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        split = next(x for x in json.load(open(path, encoding="utf-8"))["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        step = pre_tokenizers.Split(_library_regex(split["pattern"]["Regex"]), split["behavior"].lower(), invert=split["invert"])
        self.cut_by_library = lambda w: [piece for piece, _ in step.pre_tokenize_str(w)]
        every = "".join(map(chr, ASSIGNED))
        odd = {c for c in every if self.normal(c) != self.white.sub(" ", unicodedata.normalize("NFC", c).lower()) or unicodedata.category(c) == "Cn"}
        # marks: their order among marks of other classes too
        marks = [c for c in every if unicodedata.combining(c)]
        around = [f"a{x}%s{y}" for x in "\u0334\u0323\u0301" for y in "\u0334\u0323\u0301"]
        odd |= {c for c in marks if any(self.normal(t % c) != unicodedata.normalize("NFC", t % c) for t in around)}
        for library, own in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", f"[{WHITE}]")):
            kept = pre_tokenizers.Split(_library_regex(library), "removed").pre_tokenize_str(every)
            odd |= set(every).difference(*(piece for piece, _ in kept)) ^ set(regex.findall(own, every))
        self.odd, self.odd_points = frozenset(odd), np.zeros(0x110000, bool)
        self.odd_points[[ord(c) for c in odd]] = True

    def is_odd(self, text: str) -> bool:
        if len(text) < 40:
            return not self.odd.isdisjoint(text)
        return bool(self.odd_points[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for text, i in self.special.items():  # under a name with a space, which no chunk has
            self._append([" " + text], np.array([i], np.int32), np.array([1]))

    def _append(self, new: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.len), len(self.len) + len(new)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def chunks(self, text: str) -> list[str]:
        """The text, normalised and cut at white space; special tokens stand alone, behind a space."""
        out: list[str] = []
        for part in self.cut.split(text) if self.special and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(" " + part)
                continue
            if not part.isascii() and self.is_odd(part):
                out += self.normal(part).strip(" ").split(" ")
                continue
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            low = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            # str.split() also cuts at these four, which are no white space in Unicode
            out += self.white.sub(" ", low).strip(" ").split(" ") if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()
        return out

    def merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of the words, by merge rounds."""
        raw = [w.encode() for w in new]
        lens = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(new)), lens)
        done_word, done_sym = [], []
        while len(sym):
            inside = word[:-1] == word[1:]
            key = sym[:-1] * self.n + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], len(self.made))
            rank = np.append(rank, len(self.made))
            starts = np.flatnonzero(np.append(True, ~inside))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            going = low < len(self.made)
            keep = np.repeat(going, sizes)
            done_word.append(word[~keep])
            done_sym.append(sym[~keep])
            hit = keep & (rank == np.repeat(low, sizes))
            # of overlapping hits (as in aaa) every second one counts, from the left
            where = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(where) > 1) if len(where) else np.zeros(0, bool)
            run_start = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))] if len(where) else where
            where = where[(where - run_start) % 2 == 0]
            sym[where] = self.made[rank[where]]
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = np.concatenate([*done_word, word]), np.concatenate([*done_sym, sym])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if len(self.known) > MAX_KNOWN:
            self.forget()
        cut = [self.chunks(t) for t in texts]
        new = list({w for c in cut for w in c}.difference(self.known))
        if new:
            pieces = [self.split.findall(w) if w.isascii() or not self.is_odd(w) else self.cut_by_library(w) for w in new]
            ids, lens = self.merged([p for w in pieces for p in w])
            of = np.repeat(np.arange(len(new)), [len(w) for w in pieces])
            self._append(new, ids, np.bincount(of, lens, len(new)).astype(np.int64))
        k = np.fromiter((self.known[w] for c in cut for w in c), np.int64)
        ids = gather(self.flat, self.at[k], self.len[k])
        per = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        return ids, np.bincount(per, self.len[k], len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts (tokens joined by a space) in one array, and each one's bytes."""
        data = gather(self.token_bytes, self.token_at[ids], self.token_len[ids])
        per = np.repeat(np.arange(len(counts)), counts)
        size = np.bincount(per, self.token_len[ids], len(counts)).astype(np.int64)
        last = np.cumsum(size)[size > 0] - 1  # no space after the last token
        return np.delete(data, last), size - (size > 0)


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices ``flat[at : at + len]``, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - (ends - lens), lens)]


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def runs(texts: list[str | None], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, ids array<int>, decoded string`` of every text, in one pass."""
    kind = docs.schema[key].dataType.simpleString()

    def coded(batches):
        words = words_of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs(texts):
                ids, n = words.encode([t or "" for t in texts[a:b]])
                data, size = words.decode(ids, n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                strings = pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, strings], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(coded, f"{key} {kind}, ids array<int>, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
