"""BPE encoding and decoding with a transducer lexicon.

Frequent words (by default the whole words of the vocabulary, which are the frequent words of the corpus that it was
made from) are compiled with their ids into a minimal acyclic automaton: suffixes are shared, the number of a word
follows from the paths that are passed by, and its ids stand in one array under that number. The file lies in the
shared folder, Spark hands it to every executor, and their Python workers memory-map it. Words that the lexicon lacks
are merged by the ranks of the vocabulary, exactly.

Cases: of merges with equal rank the leftmost comes first; texts are encoded whole; an empty table gives an empty table;
a null or empty text has no tokens (empty ids, empty decoded text); repeated rows give repeated results; very
long words are merged with a heap, in n log n time; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import shared_dir, small_batches

END = "</w>"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The parts of a vocabulary file that this module does the work of; a file with others is refused.
HANDLED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
HANDLED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": None, "ignore_merges": None}
SPACES = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SHORT = 24  # symbols; longer words are merged with a heap
CACHED_WORD, CACHED_WORDS = 32, 150_000  # per worker, kind and generation
ROWS = 256


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return [x for _, x in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + n)) for n, b in enumerate(rest)])]


class Merger:
    """Vocabulary and merge ranks; turns one piece into its tokens."""

    def __init__(self, spec: dict):
        self.vocab: dict[str, int] = spec["vocab"]
        self.ranks: dict[tuple[str, str], int] = {(a, b): n for n, (a, b) in enumerate(spec["merges"])}
        self.special: dict[str, int] = spec["special"]
        self.letters = byte_letters()

    @staticmethod
    def read(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        other = [k for k, want in HANDLED.items() if (tokenizer.get(k) or None) != want] + [k for k, want in HANDLED_MODEL.items() if (tokenizer["model"].get(k) or None) != want]
        if other:
            raise ValueError(f"{path}: this {', '.join(other)} is not handled")
        merges = [m.split(" ") if isinstance(m, str) else m for m in tokenizer["model"]["merges"]]
        return {"vocab": tokenizer["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in tokenizer["added_tokens"]}}

    def symbols(self, piece: str) -> list[str]:
        parts = [self.letters[b] for b in piece.encode("utf-8")]
        parts[-1] += END
        return parts

    def tokens(self, piece: str) -> list[str]:
        parts = self.symbols(piece)
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[str]) -> list[str]:
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


def compile_lexicon(outputs: dict[bytes, list[int]]) -> bytes:
    """A file with the words' automaton and ids. States with the same continuations are one state."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    below: list[int] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            below.append(final + sum(below[t] for _, t in edges))
        return register[key]

    words = sorted(w for w in outputs if w)
    path: list[list] = [[False, []]]  # open states of the last word: final, settled edges
    last = b""

    def close(to: int) -> None:
        while len(path) - 1 > to:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, edges)))

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0)
    root = settle(*path[0])

    labels, first, target, skip, final = bytearray(), array("I"), array("I"), array("I"), bytearray()
    for is_final, edges in states:
        first.append(len(labels))
        final.append(is_final)
        passed = int(is_final)
        for label, to in edges:
            labels.append(label)
            target.append(to)
            skip.append(passed)
            passed += below[to]
    first.append(len(labels))
    starts, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(outputs[word])
        starts.append(len(ids))
    parts = [first.tobytes(), target.tobytes(), skip.tobytes(), starts.tobytes(), ids.tobytes(), bytes(labels), bytes(final)]
    return struct.pack("<8Q", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon over a memory map (or bytes)."""

    def __init__(self, buffer):
        self.root, *sizes = struct.unpack("<8Q", buffer[:64])
        view, at, parts = memoryview(buffer), 64, []
        for size in sizes:
            parts.append(view[at : at + size])
            at += size
        self.first, self.target, self.skip, self.starts, self.ids = (p.cast("I") for p in parts[:5])
        self.labels, self.final = bytes(parts[5]), parts[6]

    @staticmethod
    def open(path: str) -> Lexicon:
        with open(path, "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        for byte in word:
            edge = self.labels.find(byte, self.first[state], self.first[state + 1])
            if edge < 0:
                return None
            number += self.skip[edge]
            state = self.target[edge]
        if not self.final[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Decoder:
    """Ids to text: the tokens' names, parted by spaces, as a vocabulary without a decoder of its own is decoded."""

    def __init__(self, vocab: dict[str, int], special: dict[str, int]):
        self.name = {n: t for t, n in [*vocab.items(), *special.items()]}

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary lacks give nothing."""
        return " ".join([self.name[i] for i in ids if i in self.name])


class _Cache(dict):
    """A string to what it becomes; filled on demand. Of a full generation those asked for again pass into the next, so
    memory is bounded and frequent words stay."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.most = CACHED_WORDS
        self.before: dict = {}

    def hold(self, most: int) -> None:
        """At most `most` strings a generation from now on; what is held beyond that goes."""
        self.most = most
        if len(self) > most:
            self.clear()
        if len(self.before) > most:
            self.before = {}

    def __missing__(self, string: str):
        made = self.before.pop(string, None)
        if made is None:
            made = self.make(string)
        if len(string) <= CACHED_WORD:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[string] = made
        return made


class Encoder:
    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        self.decoder = Decoder(merger.vocab, merger.special)
        self.special = regex.compile("(" + "|".join(map(regex.escape, merger.special)) + ")") if merger.special else None
        self.of_piece = _Cache(self.encode_piece)
        self.of_chunk = _Cache(self.encode_chunk)

    def encode_piece(self, piece: str) -> list[int]:
        ids = self.lexicon.get(piece.encode("utf-8"))
        return [self.merger.vocab[t] for t in self.merger.tokens(piece)] if ids is None else ids

    def encode_chunk(self, chunk: str) -> tuple[str, str]:
        """A run without white space: its ids, and what they decode to. Lower-casing goes letter by letter: a final sigma
        is an ordinary one."""
        ids = [i for p in PIECE.findall(chunk.replace("Σ", "σ").lower()) for i in self.of_piece[p]]
        return " ".join(map(str, ids)), self.decoder.decode(ids)

    def encode(self, text: str | None) -> tuple[str, str]:
        """Ids of a text, joined by spaces, and the text that they decode to: that of its runs, parted as tokens are."""
        ids, decoded = [], []
        for part in self.special.split(text or "") if self.special and "<" in (text or "") else [text or ""]:
            if part in self.merger.special:
                ids.append(str(self.merger.special[part]))
                decoded.append(self.decoder.decode([self.merger.special[part]]))
            else:
                part = unicodedata.normalize("NFC", part)
                # str.split also splits at \x1c to \x1f, which are no white space here
                chunks = SPACES.split(part) if SEPARATORS.search(part) else part.split()
                made = [self.of_chunk[c] for c in chunks if c]
                ids += [x for x, _ in made if x]
                decoded += [y for x, y in made if x]
        return " ".join(ids), " ".join(decoded)


def store_lexicon(spark: SparkSession, compiled: bytes, vocabulary: str) -> str:
    """Put the file into the shared folder, have Spark hand it to the executors, and give its name there, which no other
    lexicon or vocabulary has."""
    name = f"lexicon-{hashlib.sha256(compiled + vocabulary.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(compiled))
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


_OPEN: dict[str, Encoder] = {}


def opened(name: str, vocabulary: Broadcast) -> Encoder:
    """The encoder of a lexicon file, made once in each Python worker; the name tells vocabulary and lexicon."""
    if name not in _OPEN:
        _OPEN.clear()  # one vocabulary at a time
        _OPEN[name] = Encoder(Merger(vocabulary.value), Lexicon.open(SparkFiles.get(name)))
    return _OPEN[name]


def encode_texts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", frequent: list[str] | None = None, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    tokenizer: path of the vocabulary file on the driver. frequent: words for the lexicon; by default the vocabulary's
    whole words. cached_words: strings of each kind that a worker keeps with their ids, twice at most; fewer cost time,
    not results.
    """
    spark = docs.sparkSession
    spec = Merger.read(tokenizer)
    merger = Merger(spec)
    if frequent is None:
        letters = {x: b for b, x in enumerate(merger.letters)}
        whole = [bytes(letters[c] for c in t[: -len(END)]) for t in spec["vocab"] if t.endswith(END) and t != END]
        frequent = [w for b in whole if (w := b.decode("utf-8", "ignore")).encode("utf-8") == b]
    compiled = compile_lexicon({w.encode("utf-8"): [merger.vocab[t] for t in merger.tokens(w)] for w in frequent if w})
    lexicon = store_lexicon(spark, compiled, json.dumps(spec, sort_keys=True))
    vocabulary = spark.sparkContext.broadcast(spec)

    def encode(batches):
        from tracelake.llm import bpe  # the worker's module, which outlives the task; this function comes by value

        encoder = bpe.opened(lexicon, vocabulary)
        for cache in (encoder.of_piece, encoder.of_chunk):
            cache.hold(cached_words)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts, ids_sha, decoded_sha, all_ids = [], [], [], []
                for value in part.column(1).to_pylist():
                    ids, decoded = encoder.encode(value)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append(list(map(int, ids.split())))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = small_batches(docs).select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encode, schema)


def decode_texts(encoded: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the column `to`: the text that the ids decode to. Null ids give a null text."""
    spec = Merger.read(tokenizer)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Decoder(spec["vocab"], spec["special"]))

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = vocabulary.value
        for lists in batches:
            yield lists.map(lambda x: None if x is None else decoder.decode(list(x)))

    return encoded.withColumn(to, F.pandas_udf(decode, "string")(F.col(f"`{ids}`")))
