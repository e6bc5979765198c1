"""BPE encoding and decoding with tree concatenation for long unsplit text.

Texts are split at ASCII white space, which no piece of the pre-tokeniser crosses.  The rows of a group count their words by
number, and the words that are new are encoded together: those of plain characters by their distinct pieces.  A piece of more
than ``LEAF`` characters (a long word, or a run without white space of any length) is encoded as a tree: its leaves together,
then level by level each pair of halves is joined by re-encoding a window of tokens around the join, grown until its outermost
token on either side equals the token that was there.  A BPE encoding is the right one exactly if every adjacent pair
of tokens re-encodes to itself; tokens inside the halves and inside the window do, and the shared
outer tokens link the two, so the join is exact.
"""

from __future__ import annotations

import codecs
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, compress, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .runtime import small_batches, tidy

#: Symbols of a leaf, and tokens on either side of a join in its first window.
LEAF, WINDOW = 12, 2
#: Leaves and windows above this number (of a MB without white space) are encoded as one batch of the library, which works on
#: them in parallel, but takes twice the CPU time.
BATCH = 100_000
#: Words and pieces that a task remembers between groups of rows, and the bytes of one: memories only save time.  When there are
#: more words, those met twice or more in the last group stay (none, if these are as many); more pieces are all forgotten.
REMEMBERED, LONG = 30_000, 48
#: New words that are encoded together.
TOGETHER = 8192
#: Bytes of text after which a group of rows ends, and of words after which their memory is cut.
GROUP_BYTES = 1 << 20

#: Words whose pieces can be told without the library's normaliser: printable ASCII but the apostrophe, and letters of Latin-1.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: Pieces of lower-cased plain words, and the ends of these.
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")


def byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary (printable ones for themselves); line ends stay, to split by."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)} | {10: "\n"}
    return "".join(letter[b] for b in range(256))


def packed(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    return [flat[a:b] for a, b in pairwise(accumulate((4 * len(x) for x in ids), initial=0))]


class WordBpe:
    """Encoder and decoder of one vocabulary file in the format of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf, self.window = leaf, window
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = Tokenizer(BPE(vocab=model["vocab"], merges=merges))
        self.last = Tokenizer(self.full.model) if self.suffix else self.inner
        self.letters, self.pieces, self.model, self.within = byte_letters(), {}, self.last.model, self.inner.model
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*model["vocab"].items(), *special.items()]:
            self.tokens[i] = t
        self.strings = pa.array(self.tokens, pa.string())
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word (text without white space)."""
        plain = [_PLAIN.fullmatch(w) is not None and "<|" not in w for w in words]
        easy = iter(self.encode_plain(list(compress(words, plain))))
        other = [w for w, easily in zip(words, plain, strict=True) if not easily]
        short = [w for w in other if len(w) <= self.leaf]
        found = iter(self.full.encode_batch_fast(short, add_special_tokens=False))
        hard = iter(packed([next(found).ids if len(w) <= self.leaf else self.encode_long(w) for w in other]))
        return [next(easy) if easily else next(hard) for easily in plain]

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of plain characters: the distinct pieces that are not remembered are encoded together."""
        pieces = _PIECE.findall("".join([w + "\n" for w in words]).lower())
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces and p != "\n"]
        texts = codecs.charmap_decode("\n".join(new).encode(), "strict", self.letters)[0].split("\n") if new else []
        short = [len(t) <= self.leaf for t in texts]
        whole = iter(self.encoded(list(compress(texts, short)), True))
        trees = iter(self.trees([t for t, is_short in zip(texts, short, strict=True) if not is_short]))
        coded = self.pieces | {"\n": b""} | dict(zip(new, packed([next(whole if is_short else trees) for is_short in short]), strict=True))
        codes = list(map(coded.__getitem__, pieces))
        self.pieces.update((p, coded[p]) for p in new if len(p.encode()) <= LONG)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat, ends = b"".join(codes), np.cumsum(sizes)[sizes == 0].tolist()
        return [flat[a:b] for a, b in pairwise([0, *ends])]

    def encoded(self, texts: list[str], last: bool) -> list[list[int]]:
        """Ids of texts inside a piece (``last``: that end it), in symbols."""
        if len(texts) > BATCH:
            return [e.ids for e in (self.last if last else self.inner).encode_batch_fast(texts, add_special_tokens=False)]
        tokenize = self.model.tokenize if last else self.within.tokenize
        return [[t.id for t in tokenize(x)] for x in texts]

    def encode_long(self, text: str) -> list[int]:
        """Ids of a long text without white space, by tree concatenation of its long pieces."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += chain.from_iterable(self.trees([piece for piece, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(part))]))
        return ids

    def trees(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces of the pre-tokeniser: leaves of at most ``leaf`` symbols, joined pairwise, all pieces' levels together."""
        leaves = [[p[i : i + self.leaf] for i in range(0, len(p), self.leaf)] for p in pieces]
        within = iter(self.encoded([x for p in leaves for x in p[:-1]], False))
        parts = [[*islice(within, len(p) - 1), last] for p, last in zip(leaves, self.encoded([p[-1] for p in leaves], True), strict=True)]
        while several := [p for p in parts if len(p) > 1]:
            joined = iter(self.join([(p[i], p[i + 1], i + 2 >= len(p)) for p in several for i in range(0, len(p) - 1, 2)]))
            for p in several:
                p[:] = [*islice(joined, len(p) // 2), *(p[-1:] if len(p) % 2 else [])]
        return [p[0] for p in parts]

    def text_of(self, ids: list[int], last: bool) -> str:
        s = "".join(self.tokens[i] for i in ids)
        return s[: -len(self.suffix)] if last and self.suffix else s

    def join(self, pairs: list[tuple[list[int], list[int], bool]]) -> list[list[int]]:
        """Joins each (left, right, right ends the piece); all open windows of a level are encoded in one batch."""
        out: list[list[int] | None] = [None] * len(pairs)
        open_, w = list(range(len(pairs))), self.window
        while open_:
            fresh = {}
            for ends in (False, True):
                at = [i for i in open_ if (pairs[i][2] and w >= len(pairs[i][1])) == ends]
                texts = [self.text_of(pairs[i][0][-w:] + pairs[i][1][:w], ends) for i in at]
                fresh |= zip(at, self.encoded(texts, ends), strict=True)
            for i, new in fresh.items():
                left, right, _ = pairs[i]
                if (w >= len(left) or new[0] == left[-w]) and (w >= len(right) or new[-1] == right[w - 1]):
                    out[i] = left[: max(0, len(left) - w)] + new + right[w:]
            open_ = [i for i in open_ if out[i] is None]
            w *= 2
        return out  # type: ignore[return-value]

    def decode(self, rows: list[bytes]) -> pa.Array:
        """Each row's token strings joined by one space, special tokens kept (the file names no decoder)."""
        ids = np.frombuffer(b"".join(rows), "<u4")
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.strings.take(pa.array(ids))), " ")


def _numbered(words: Iterable[bytes] = ()) -> defaultdict[bytes, int]:
    """Words' numbers from zero; a word that is asked for and not there gets the next."""
    numbers = {w: k for k, w in enumerate(words)}
    return defaultdict(count(len(numbers)).__next__, numbers)


def _coded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        bpe = WordBpe(path)
        numbers, codes, held = _numbered(), [], 0
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            first, rows, size = 0, [], 0
            for k, text in enumerate(texts):
                words = (text.as_py() or b"").split()
                rows.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(text.as_py() or b"")
                if size <= GROUP_BYTES and k + 1 < len(texts):
                    continue
                if len(numbers) > len(codes):
                    new = islice(numbers, len(codes), None)
                    while some := b"\n".join(islice(new, TOGETHER)):
                        codes += bpe.encode_words(some.decode().split("\n"))
                        held += len(some)
                raw = [b"".join(map(codes.__getitem__, row.tolist())) for row in rows]
                columns = [ids[first : k + 1].cast(pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(raw, pa.binary()), bpe.decode(raw)]
                if len(codes) > REMEMBERED or held > GROUP_BYTES:
                    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
                    keep = (np.bincount(np.concatenate(rows), minlength=len(codes)) > 1) & (sizes <= LONG)
                    keep &= keep.sum() <= REMEMBERED
                    numbers, codes, held = _numbered(compress(numbers, keep)), list(compress(codes, keep)), int(sizes[keep].sum())
                first, rows, size = k + 1, [], 0
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return tidy(run)


def bpe_encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text.

    Null texts count as empty: no tokens, empty ids, empty decoded text.  Rows are independent
    (no shuffle), so repeated rows give repeated results, and rows without a doc_id theirs; an empty table gives no rows.
    Other columns are ignored, whatever their names; a long text is encoded whole.
    ``path`` is the vocabulary file's place on every machine.
    """
    small_batches(documents.sparkSession)
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(_coded(path), "doc_id long, n_tokens long, ids binary, decoded string")
