"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

Layout of a folder:
  shard-00000.bin   ids of its documents one after the other, little-endian uint16
                    or uint32 (the smallest that holds the vocabulary)
  shard-00000.idx   per shard, little-endian 64-bit: number of documents n, then n + 1
                    offsets in ids, then the n doc_ids, then n flags (1: doc_id is null)
  manifest.json     kind of integer, shards with their counts, and each shard's base,
                    the number of ids before it: the prefix sum of the counts

Documents are dealt by ranges of doc_id (nulls first, then ascending; rows with the
same doc_id by text) and sorted inside a range, so the shards in order hold all
documents in order. A task writes under a name of its own and renames, and the same
rows give the same bytes, so a task that runs twice leaves one good file. The
driver only adds up one count per shard.

Words repeat, so a Python worker remembers up to WORD_CACHE white-space-separated words
and encodes only the others; the vocabulary this is written for never joins across white
space, which `plain_spaces` decides from its pre-tokenizer. Other vocabularies are
given whole texts. Null and empty texts hold the end id alone.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pick, shared_folder
from .words import frugal

END = 1
WORD_CACHE = 2_000_000
MERGE_AT = 50_000
TEXTS_AT_ONCE = 200
#: signs that Python takes for white space and a tokenizer may not
ODD_SPACE = re.compile(r"[\x1c-\x1f]")
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
FORMAT = "flat-ids-1"


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def plain_spaces(spec: dict) -> bool:
    """Whether a vocabulary drops white space and never joins ids across it: no special
    text holds white space or strips it, white space is dropped when texts are cut, and
    nothing is added to a text's ends."""
    normal = json.dumps(spec.get("normalizer") or {})
    cut = json.dumps(spec.get("pre_tokenizer") or {})
    marks = spec.get("added_tokens") or []
    return ("ByteLevel" in cut and "Split" in cut and '"add_prefix_space": false' in cut
            and '"Removed"' in cut and "Prepend" not in normal
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in marks))


class Encoder:
    """Ids of texts; every different word is encoded once while it is remembered.

    Words are known by a 64-bit keyed hash, so a word takes about 40 bytes: sorted
    hashes, a place and its ids in flat arrays. The newest words wait in a short
    table of their own that is merged when it is full. Two of WORD_CACHE words share
    a hash with a probability near 1e-7.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            self.by_word = plain_spaces(json.load(f))
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self):
        self.n, self.used = 0, 0
        self.ids = np.zeros(1 << 16, dtype=self.kind)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.tables = [(np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        flat, sizes = [], []
        for k in range(0, len(texts), 2000):
            for e in self.lib.encode_batch(texts[k:k + 2000], add_special_tokens=False):
                own = e.ids
                sizes.append(len(own))
                flat.extend(own)
        return np.array(flat, dtype=self.kind), np.array(sizes, dtype=np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashed words, -1 for unknown ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, place in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = place[at[hit]]
        return out

    def _learn(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        ids, sizes = self._library(words)
        n, used = self.n, self.used
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        if n + len(words) + 1 > len(self.start):
            self.start = np.resize(self.start, 2 * (n + len(words) + 1))
        self.ids[used:used + len(ids)] = ids
        self.start[n:n + len(words) + 1] = used + np.concatenate([[0], np.cumsum(sizes)])
        self.n, self.used = n + len(words), used + len(ids)
        place = np.arange(n, self.n, dtype=np.int32)
        old, new = self.tables
        new = self._merged(new, keys, place)
        self.tables = [self._merged(old, *new), (keys[:0], place[:0])] if len(new[0]) > MERGE_AT else [old, new]
        return place

    @staticmethod
    def _merged(table, keys, place):
        every, places = np.concatenate([table[0], keys]), np.concatenate([table[1], place])
        order = np.argsort(every, kind="stable")
        return every[order], places[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            flat, sizes = self._library(texts)
            return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []
        if self.n > WORD_CACHE:
            self.forget()
        split = [[w for w in ASCII_SPACE.split(t) if w] if ODD_SPACE.search(t) else t.split() for t in texts]
        words = list(set().union(*split))
        keys = np.fromiter(map(hash, words), np.int64, len(words))
        place = self._find(keys)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = self._learn([words[i] for i in fresh], keys[fresh])
        of, out = dict(zip(words, place.tolist())), []
        for row in split:
            at = np.fromiter(map(of.__getitem__, row), np.int64, len(row))
            begin = self.start[at]
            size = self.start[at + 1] - begin
            first = np.cumsum(size) - size
            out.append(self.ids[np.repeat(begin - first, size) + np.arange(int(size.sum()))])
        return out


@cache
def encoder_of(path: str, special_as_text: bool) -> Encoder:
    """The encoder of this Python worker: the tasks it runs share what it remembers."""
    return Encoder(path, special_as_text)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END,
              shards: int | None = None, special_as_text: bool = False) -> dict:
    """Write doc_id, text as token files into folder; returns the manifest."""
    path = vocabulary or vocabulary_file()
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
            .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
            .withColumn("shard", F.spark_partition_id()))

    @frugal
    def run(it):
        encoder, store, shard = encoder_of(path, special_as_text), None, None
        sizes, ids, nulls, total, first, last = [], [], [], 0, None, None
        for batch in it:
            if not batch.num_rows:
                continue
            if store is None:
                shard = batch.column("shard")[0].as_py()
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/shard-{shard:05d}"
                mark = uuid.uuid4().hex
                out = store.open_output_stream(f"{name}.bin.{mark}")
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                texts = [t or "" for t in batch.column("text").slice(k, TEXTS_AT_ONCE).to_pylist()]
                for found in encoder.encode(texts):
                    out.write(found.tobytes())
                    out.write(np.array([end], dtype=encoder.kind).tobytes())
                    sizes.append(len(found) + 1)
            doc = batch.column("doc_id")
            nulls.append(doc.is_null().to_numpy(zero_copy_only=False))
            ids.append(doc.fill_null(0).to_numpy())
        if store is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        with store.open_output_stream(f"{name}.idx.{mark}") as index:
            index.write(np.array([len(sizes)], dtype="<i8").tobytes())
            for part in (offsets, np.concatenate(ids), np.concatenate(nulls)):
                index.write(part.astype("<i8").tobytes())
        for kind in ("idx", "bin"):
            store.move(f"{name}.{kind}.{mark}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(sizes)], pa.int64()),
             pa.array([int(offsets[-1])], pa.int64()), pa.array([encoder.kind.str])],
            names=["shard", "documents", "ids", "kind"])

    told = sorted(rows.mapInArrow(run, "shard int, documents long, ids long, kind string").collect())
    base, listed = 0, []
    for r in told:
        listed.append({"shard": r.shard, "documents": r.documents, "ids": r.ids, "base": base})
        base += r.ids
    manifest = {"format": FORMAT, "kind": told[0].kind if told else "<u2", "ids": base, "shards": listed}
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard, memory-mapped where the folder is a file system's."""

    def __init__(self, folder: str, shard: int, kind: str):
        store, root = _store(folder)
        name = f"{root}/shard-{shard:05d}"
        local = isinstance(store, pafs.LocalFileSystem)

        def load(path, dtype):
            if local:
                return np.memmap(path, dtype=dtype, mode="r")
            with store.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype=dtype)

        index = load(f"{name}.idx", "<i8")
        n = int(index[0])
        self.offsets, self.doc_ids, self.nulls = index[1:n + 2], index[n + 2:2 * n + 2], index[2 * n + 2:] != 0
        self.ids = load(f"{name}.bin", kind)

    def __len__(self):
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def read_manifest(folder: str) -> dict:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_ids(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files; one task per shard."""
    manifest = read_manifest(folder)
    kind = manifest["kind"]
    shards = [(s["shard"], s["base"]) for s in manifest["shards"]]
    table = spark.createDataFrame(shards, "shard int, base long").repartition(max(1, len(shards)))

    @frugal
    def run(it):
        for batch in it:
            for shard, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "base"))):
                own = Shard(folder, shard, kind)
                for at in range(0, len(own), 10_000):
                    span = range(at, min(at + 10_000, len(own)))
                    crc = [zlib.crc32(own[i].astype("<u4").tobytes()) for i in span]
                    low, high = own.offsets[at:span.stop], own.offsets[at + 1:span.stop + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.doc_ids[at:span.stop], mask=np.array(own.nulls[at:span.stop])),
                         pa.array(base + low), pa.array(high - low), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the token files of docs into the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, vocabulary)
    return read_ids(spark, folder)
