"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

For each prefix of a word the last token of its encoding is unique: the one
token that ends there and is compatible with the last token before it (the two
together encode to just those two). A token that ends later starts within the
last `lookahead` symbols, the length of the longest token that the merge list
makes; where the paths back from all those places meet, everything before is
final and is emitted. Only the window after the meeting place is kept.

Defined results: a null or empty text has no tokens; ids and decoded text of
a text don't depend on other rows; repeated rows give repeated results, and a row
without an id has one like any other; texts of any length are encoded whole, in parts
cut at white space, which no token crosses; ties can't occur, as the merges are ordered;
an empty table gives no rows; extra columns are ignored. The vocabulary is read from the path given, on the driver,
and sent to the executors as one broadcast of a fixed size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import caches, lean, tuned

END = "\ue000"  # stands for the end-of-word suffix as part of the last symbol
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Ranges of code points that the splitter's tables know as letters or numbers
# and Unicode 16, which the encoding is defined by, does not.
NEWER = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9"
    "\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff"
    "\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168"
    "\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2"
    "\\U0001e6e4\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
# Lower case of capitals that this Python's tables don't have yet.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CHUNK = 1 << 16  # characters of a text handled at once
CACHED = 120_000  # words whose encoding a worker keeps in each of two generations
START = 6  # symbols of a word whose last tokens it keeps
NEAR = 5  # symbols before a place whose tokens it keeps
PAIRS = 250_000  # pairs of tokens whose fit it keeps


def byte_alphabet() -> list[str]:
    """The printable character of each byte, as byte-level vocabularies write it."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merge list, its tokens and the sufficient lookahead."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        named = (lambda s: s[: -len(self.suffix)] + END if self.suffix and s.endswith(self.suffix) else s)
        self.ids = {named(s): i for s, i in model["vocab"].items()}
        self.strings = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(named(a), named(b)): k for k, (a, b) in enumerate(pairs)}
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[int, str, str] | None] = {}
        made = {a + b for a, b in self.rank} | {s for s in self.ids if self.symbols(s) == 1}
        self.lookahead = max(map(self.symbols, made), default=1)
        self.tokens = {s for s in made if s in self.ids}
        #: All ends of tokens, and whether each is a token itself.
        self.ends = {s[k:]: s[k:] in self.tokens for s in self.tokens for k in range(len(s))}

    @staticmethod
    def symbols(s: str) -> int:
        return len(s) - (len(s) > 1 and s[-1] == END)

    def reduce(self, s: str) -> list[str]:
        """Encoding of a short string by merging the lowest-ranked pair, leftmost first."""
        parts = [*s[:-2], s[-2:]] if len(s) > 1 and s[-1] == END else list(s)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def made_by(self, s: str) -> tuple[int, str, str] | None:
        """The merge that makes s when s is encoded alone: (rank, left, right); None
        for a single symbol, and rank -1 for a token that encoding never makes."""
        got = self.parts.get(s, 0)
        if got == 0:
            pairs = [(r, a, b) for a, b in ((s[:i], s[i:]) for i in range(1, self.symbols(s))) if (r := self.rank.get((a, b))) is not None]
            if self.symbols(s) == 1:
                got = None
            elif self.reduce(s) != [s]:
                got = (-1, "", "")
            else:
                got = next((x for x in sorted(pairs) if self.compatible(x[1], x[2], x[0]) and self.usable(x[1]) and self.usable(x[2])), min(pairs))
            self.parts[s] = got
        return got

    def usable(self, s: str) -> bool:
        made = self.made_by(s)
        return made is None or made[0] >= 0

    def compatible(self, a: str, b: str, until: int = 1 << 60) -> bool:
        """Whether no merge across the border of a and b comes before both are made.
        The making of both is undone step by step, the later step first; of equal
        ranks the left one comes first."""
        while True:
            if (r := self.rank.get((a, b))) is not None and r < until:
                return False
            x, y = self.made_by(a), self.made_by(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[0] > y[0]:
                until, a = x[0], x[2]
            else:
                until, b = y[0] + 1, y[1]

    def follows(self, a: str, b: str) -> bool:
        """compatible, remembered; an empty a is the start of a word."""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            if len(self.pair_ok) > PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self.usable(b) and (not a or self.compatible(a, b))
        return ok


class Transducer:
    """Encodes one word given piece by piece; emits tokens as soon as they are final."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = ""  # symbols after the last final token
        self.last = [""]  # last[i]: last token of the encoding of text[:i]; the first is that before the text
        self.checked = 0

    def step(self, text: str, end: int) -> str:
        """The last token of the encoding of text up to end; the final symbol may carry END."""
        m, symbols = self.m, end - (text[end - 1] == END)
        for start in range(max(0, symbols - m.lookahead), symbols):
            token = text[start:end]
            if token in m.tokens and m.follows(self.last[start], token):
                return token
        return text[symbols - 1 : end]  # a symbol outside the vocabulary stays alone

    def feed(self, symbols: str) -> list[str]:
        out = []
        for c in symbols:
            self.text += c
            self.last.append(self.step(self.text, len(self.text)))
            if len(self.text) >= 4 * self.m.lookahead + self.checked:
                out += self.settle()
        return out

    def settle(self) -> list[str]:
        """Emit what all paths back from the places where a later token can start share."""
        n = len(self.text)
        places = set(range(max(0, n - self.m.lookahead), n + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - len(self.last[top]))
        (meet,) = places
        out = self.back(meet)
        if meet:
            self.text, self.last = self.text[meet:], self.last[meet:]
        self.checked = len(self.text)
        return out

    def back(self, at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.last[at])
        return out[::-1]

    def finish(self, final: str) -> list[str]:
        """The word's last symbol, marked as such."""
        text = self.text + final
        token = self.step(text, len(text))
        return [*self.back(len(text) - len(token)), token]


class Decoder:
    """Ids to text, as they come. A vocabulary without a decoder gives token strings
    joined by one space; `raw` gives the bytes that they stand for, through an
    incremental UTF-8 decoder that holds at most three bytes of an unfinished character."""

    def __init__(self, merges: Merges, raw: bool = False):
        self.m, self.raw, self.first = merges, raw, True
        self.back = {c: b for b, c in enumerate(byte_alphabet())} if raw else {}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        out = []
        for i in ids:
            s = self.m.strings[i]
            if self.raw:
                end = bool(self.m.suffix) and s.endswith(self.m.suffix)
                body = s[: -len(self.m.suffix)] if end else s
                out.append(self.state.decode(bytes(self.back[c] for c in body if c in self.back) + b" " * end))
            else:
                out.append(s if self.first else " " + s)
                self.first = False
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.raw else ""


class Codec:
    """Normaliser, splitter, transducer and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        self.m = Merges(json.loads(spec))
        self.alphabet = byte_alphabet()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+", regex.V0)
        new = f"[{NEWER}]"
        self.wide = regex.compile("[\\u0558-\\U0010ffff]")
        self.rare = regex.compile(f"[{NEWER}{''.join(map(chr, CAPITALS))}]")
        self.exact = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{new})\p{{L}})+|(?!{new})\p{{N}}|(?:{new}|[^{WHITE}\p{{L}}\p{{N}}])+", regex.V0)
        special = sorted(self.m.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.breaks = regex.compile("[\t-\r ]")
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        self.starts: dict[str, tuple[str, ...]] = {}
        self.near: dict[str, tuple[tuple[int, str], ...]] = {}

    def word(self, word: str) -> list[str]:
        """Tokens of one word; a short one needs no window, as all of it is one."""
        shown = [self.alphabet[b] for b in word.encode("utf-8")]
        end = END if self.m.suffix else ""
        if len(shown) > self.m.lookahead:
            t = Transducer(self.m)
            return t.feed("".join(shown[:-1])) + t.finish(shown[-1] + end)
        text, ends, seen, follows = "".join(shown) + end, self.m.ends, self.m.pair_ok, self.m.follows
        n = len(shown)
        start = self.starts.get(text[:START]) if n > START else None
        last = [*start] if start else [""]  # what ends at a place depends on the text before it only
        for i in range(len(last), n + 1):
            if i == START + 1 and not start:
                if len(self.starts) >= CACHED:
                    self.starts.clear()
                self.starts[text[:START]] = tuple(last)
            stop = i if i < n else len(text)
            near = text[i - NEAR if i > NEAR else 0 : stop]
            if (found := self.near.get(near)) is None:
                found = self.ending(near, i if i < NEAR else NEAR)
            if i > NEAR and ends.get(text[i - NEAR - 1 : stop]) is not None:
                found = [(i - j, text[j:stop]) for j in range(max(0, i - self.m.lookahead), i - NEAR) if ends.get(text[j:stop])] + [*found]
            for size, token in found:
                ok = seen.get((last[i - size], token))
                if ok or ok is None and follows(last[i - size], token):
                    last.append(token)
                    break
            else:
                last.append(text[i - 1 : stop])
        out, at = [], len(shown)
        while at > 0:
            out.append(last[at])
            at -= self.m.symbols(last[at])
        return out[::-1]

    def ending(self, text: str, n: int) -> tuple[tuple[int, str], ...]:
        """The tokens that end a text of n symbols, the longest first, with their symbols."""
        if len(self.near) >= CACHED:
            self.near.clear()
        got = self.near[text] = tuple((n - j, text[j:]) for j in range(n) if self.m.ends.get(text[j:]))
        return got

    def both(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """How many ids, these as bytes, and what the decoder makes of them."""
        return len(ids), struct.pack(f"<{len(ids)}I", *ids), Decoder(self.m).feed(ids).encode()

    def packed(self, word: str) -> tuple[int, bytes, bytes]:
        got = self.older.get(word)
        if got is None:
            got = self.both([self.m.ids[s] for s in self.word(word) if s in self.m.ids])
        if len(word) <= 64:
            if len(self.cache) >= CACHED:  # in place: a caller may hold it
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[word] = got
        return got

    def pieces(self, text: str):
        """Parts of a text, cut at white space, which no token crosses."""
        at = 0
        while len(text) - at > CHUNK:
            cut = self.breaks.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def encoded(self, text: str):
        """(number of tokens, ids as bytes, decoded bytes) of one word or special token after another."""
        cache, packed = self.cache, self.packed
        for piece in self.pieces(text):
            for part in self.special.split(piece) if self.special and "<|" in piece else [piece]:
                if part in self.m.special:
                    yield [self.both([self.m.special[part]])]
                    continue
                normal = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                split = self.split
                if self.wide.search(normal) and self.rare.search(normal):
                    normal, split = normal.translate(CAPITALS), self.exact
                yield [cache.get(w) or packed(w) for w in split.findall(normal)]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens and digests of ids and decoded text. The ids of a word are decoded
        once, with it, and where the decoder stood is all that passes from word to word:
        whether a token came before, which puts a space between."""
        n, ids, decoded, glue = 0, hashlib.sha256(), hashlib.sha256(), b""
        for words in self.encoded(text or ""):
            if not words:
                continue
            count, raw, shown = zip(*words, strict=True)
            if 0 in count:
                shown = [w[2] for w in words if w[0]]
            if shown:
                n += sum(count)
                ids.update(b"".join(raw))
                decoded.update(glue + b" ".join(shown))
                glue = b" "
        return n, ids.hexdigest(), decoded.hexdigest()

    def ids(self, text: str | None) -> list[int]:
        raw = b"".join(w[1] for words in self.encoded(text or "") for w in words)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids, raw: bool = False) -> str:
        d = Decoder(self.m, raw)
        return d.feed(ids) + d.finish()


def codec_of(spec: str) -> Codec:
    """One codec for each worker, that of the last vocabulary: known by its content. It
    goes when the worker turns to another operator."""
    codecs_, name = caches["bpe"], hashlib.sha256(spec.encode()).hexdigest()
    if name not in codecs_:
        codecs_.clear()
        codecs_[name] = Codec(spec)
    return codecs_[name]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of each row, whole texts."""
    spec = tuned(spark).sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        codec = codec_of(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.ids(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(run, "bpe"), "doc_id long, ids array<int>")


def digests(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, whole texts."""
    spec = tuned(spark).sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        codec = codec_of(spec.value)
        for b in batches:
            got = [codec.digest(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(run, "bpe"), schema)
