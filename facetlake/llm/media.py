"""Interleaved document sequences: HTML in, ordered text and media structs out, payloads joined by digest.

A payload is stored as a binary grey-map image (P5): 64 samples of 8 bits a row, padded with zero bytes, so the
stored form is lossless and any image reader opens it.  References in a document name the digest of the stored
form; items keep their position, and a caption stays with the media item it describes.

Defined results.  Null or empty text: a payload of 64 zero bytes, n_bytes 0.  Null html: no items.  Equal texts
give equal digests and one resolved payload.  Repeated rows stay.  A reference to an unknown digest keeps its item
with null media columns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 64
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string,n_bytes:long>"
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "td", "th", "table", "article", "section", "blockquote", "pre", "nav", "header", "footer", "br", "figure", "figcaption", "title", "body", "html", "head"}
FIELDS = ("kind", "text", "digest", "caption", "n_bytes")


class Interleaver(HTMLParser):
    """Text blocks and media references in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.hidden = 0
        self.figure: list[int] = []  # items before the open figures
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None, "n_bytes": None})

    def parse_html_declaration(self, i):
        """A marked section that HTML does not know is a comment."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.items))
        elif tag in {"img", "audio", "video", "source"}:
            self.flush()
            a = dict(attrs)
            size = a.get("data-bytes") or ""
            self.items.append({"kind": "media", "text": None, "digest": (a.get("src") or "").removeprefix("sha256:"), "caption": a.get("alt"), "n_bytes": int(size) if size.isascii() and size.isdecimal() and len(size) <= 18 else None})
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] == "media":
                    item["caption"] = text
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        elif tag in BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.parts if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    p = Interleaver()
    p.feed(html or "")
    p.close()
    if p.caption:
        p.parts.extend(p.caption)
    p.flush()
    return [{"pos": n} | x for n, x in enumerate(p.items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``items``: array of (pos, kind, text, digest, caption, n_bytes)."""
    item = pa.struct([("pos", pa.int32()), *((f, pa.int64() if f == "n_bytes" else pa.string()) for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([items_of(h) for h in b.column(b.schema.get_field_index(html)).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, items array<{ITEM}>")


def pack_media(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, stored form)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * WIDTH, b"\0")


def unpack_media(stored: bytes) -> bytes:
    kind, size, top, samples = stored.split(b"\n", 3)
    width, rows = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * rows:
        raise ValueError("not a grey map of 8 bits")
    return samples


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and the 8 x 8 average hash of the image."""
    image = samples.reshape(-1, WIDTH)
    bands = np.add.reduceat(image.reshape(len(image), 8, 8).sum(2, dtype=np.int64), np.unique(np.arange(8) * len(image) // 8), 0)
    rows = np.diff(np.append(np.unique(np.arange(8) * len(image) // 8), len(image)))
    grid = bands / (rows[:, None] * 8)
    marks = (grid > grid.mean()).ravel()
    return f"{samples.mean():.4f},{samples.std():.4f},{np.packbits(marks).tobytes().hex()}"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id", caption: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Write each text as media and as a page that refers to it.  Map-only; columns k, html, digest, media."""
    import html as h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for t, *words in zip(*(c.to_pylist() for c in part.columns[1:])):
                    n, stored = pack_media(t)
                    digest = hashlib.sha256(stored).hexdigest()
                    lead, note = h.escape(str(words[0] or "") if words else ""), h.escape(" ".join(str(w) for w in words if w is not None))
                    rows.append((f'<article><p>{lead}</p><figure><img src="sha256:{digest}" data-bytes="{n}" alt=""><figcaption>{note}</figcaption></figure></article>', digest, stored))
                html, digest, media = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(html), pa.array(digest), pa.array(media, pa.binary())], ["k", "html", "digest", "media"])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(caption)])
    return common.as_table(docs.sparkSession, picked.mapInArrow(run, f"k {kind}, html string, digest string, media binary"), "media")


def measure(media: DataFrame) -> DataFrame:
    """One row per digest of what its stored bytes hold."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = unpack_media(stored)
                rows.append((digest, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(np.frombuffer(s, np.uint8))))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([(n, pa.int64() if n in {"payload_bytes", "tail_crc32", "media_bytes"} else pa.string()) for n in names]))

    found = media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def resolve(sequences: DataFrame, media: DataFrame, items: str = "items", digest: str = "digest") -> DataFrame:
    """One row per item, media columns joined by digest; other items keep nulls and their place."""
    flat = sequences.withColumn("item", F.explode(items)).drop(items)
    refs = flat.where("item.kind = 'media'").withColumn("_d", F.col("item.digest"))
    rest = flat.where("item.kind <> 'media'")
    joined = refs.join(media.withColumnRenamed(digest, "_d"), "_d", "left").drop("_d")
    return joined.unionByName(rest, allowMissingColumns=True)


def described(html: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: items, text items, references, resolved ones, and a digest of the ordered sequence."""
    numbered = common.as_table(html.sparkSession, html.withColumn("_page", F.monotonically_increasing_id()), "media-pages")
    rows = resolve(interleave(numbered.select("_page", key, "html")).drop("html"), media)
    one = F.concat_ws("\x1f", F.col("item.kind"), F.coalesce("item.text", F.lit("")), F.coalesce("item.digest", F.lit("")), F.coalesce("item.caption", F.lit("")))
    media_item = F.col("item.kind") == "media"
    of = rows.groupBy("_page").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(media_item).alias("n_media"), F.count_if(media_item & F.col("payload_sha256").isNotNull()).alias("n_resolved"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item.pos", one.alias("x")))), lambda y: y["x"]), "\x1e"), 256).alias("sequence_sha256"),
    )
    zero = {c: 0 for c in ("n_items", "n_media", "n_resolved")}
    return numbered.select("_page", key).join(of, "_page", "left").drop("_page").fillna(zero)


def interleave_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw page as a sequence, its references looked up among the documents' media."""
    features = common.as_table(spark, measure(store(common.read(spark, sf_dir, "documents"))), "media-features")
    return described(common.read(spark, sf_dir, "pages").select("page_id", "html"), features)


def op4_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = store(common.read(spark, sf_dir, "documents"))
    # as a table, so that the join deals out its sides itself and can split a digest that many documents share
    features = common.as_table(spark, measure(table), "media-features")
    rows = resolve(interleave(table.select("k", "html")).drop("html"), features).where("item.kind = 'media'")
    return rows.select(F.col("k").alias("doc_id"), F.col("item.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"))
