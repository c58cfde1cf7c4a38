"""Interleaved document sequences: ordered text and media references of HTML, with payloads joined by digest.

A page becomes an array of parts, each a text or a reference to media with its caption. Payloads live in a
media table keyed by digest; references are resolved by joins on the digest alone, and what comes back is put
in the order of positions again, so that text, media and captions stay aligned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, stored

PART = "struct<position:int,kind:string,text:string,source:string,caption:string>"
BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th br hr blockquote pre nav header footer main figure title".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media"}
SKIPPED = frozenset(("script", "style", "template", "noscript"))
WIDTH = 576


class _Sequence(HTMLParser):
    """Collects parts in document order; a figure's caption belongs to every medium inside it, else `alt` is used."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()
        if text.strip():
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "figcaption" and self.figure is not None:
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.parts))
                self.parts.append([MEDIA[tag], None, found["src"], found.get("alt") or found.get("title")])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figure = None

    def end_caption(self) -> None:
        if self.caption is not None:
            caption = "".join(self.caption).strip()
            for at in self.figure or ():
                self.parts[at][3] = caption or self.parts[at][3]
            self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[tuple]:
    """Parts (position, kind, text, source, caption) of a page; null and empty pages have none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.flush()
    return [(i, *part) for i, part in enumerate(parser.parts)]


def sequence_column(html):
    """parse_sequence as a column."""

    @F.pandas_udf(f"array<{PART}>")
    def sequences(pages: pd.Series) -> pd.Series:
        names = ("position", "kind", "text", "source", "caption")
        return pd.Series([[dict(zip(names, part, strict=True)) for part in parse_sequence(h)] for h in pages])

    return sequences(html)


def resolve(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """(key, parts) of sequences (key, parts), one row a key: each part with what media (digest, columns...) has for its source.

    parts have position, kind, text, source and caption, of any type each. A source names a digest as
    `sha256:<hex>`; a part without one, or whose digest media has not, keeps nulls. media has one row a digest and
    holds what is wanted of payloads, such as features; a digest that a third of all rows refer to is a skewed join
    side and no group. Parts come back in the order of their positions.
    """
    extra = [c for c in media.columns if c != "digest"]
    flat = sequences.select(F.col(key), F.explode_outer("parts").alias("part"))
    # The digest is cut out of the source on both sides of the join, and not carried beside it. Parts without one have
    # nothing to be joined to, and as rows of one null key would meet in one task.
    digest = F.when(F.col("part.source").startswith("sha256:"), F.substring("part.source", 8, 64))
    joined = flat.where(digest.isNotNull()).join(media.withColumnRenamed("digest", "_media"), digest == F.col("_media"), "left").drop("_media")
    others = flat.where(digest.isNull()).select("*", *[F.lit(None).cast(media.schema[c].dataType).alias(c) for c in extra])
    joined = joined.unionByName(others)
    part = F.struct(*[F.col(f"part.{c}") for c in ("position", "kind", "text", "source", "caption")], digest.alias("digest"), *extra)
    grouped = joined.groupBy(key).agg(F.collect_list(F.when(F.col("part").isNotNull(), part)).alias("parts"))
    return grouped.select(key, F.array_sort("parts").alias("parts"))


def png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """payload as the samples of an 8-bit grey PNG of `width` columns; its length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # every line starts with its filter's number, zero
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without filters, its checksums verified."""
    at, body, width = 8, [], 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, crc = data[at + 8 : at + 8 + n], struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        if zlib.crc32(kind + part) != crc:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", part[:4])[0]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def payload_of(text: str | None, unit: int = WIDTH) -> bytes:
    """UTF-8 bytes of a text, with bytes 255 up to a positive multiple of unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def media_features(data: bytes) -> dict:
    """Digests, sizes and a summary of the samples that a stored medium gives back."""
    payload = read_png(data)
    samples = np.frombuffer(payload, np.uint8)
    octiles = np.bincount(samples >> 5, minlength=8)
    return {
        "digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": f"grey8 {WIDTH}x{len(payload) // WIDTH} mean={samples.mean():.4f} hist={'/'.join(map(str, octiles))}",
    }


FEATURES = "digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def escaped(text: Column) -> Column:
    """Text as HTML character data; the parser gives it back unchanged."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def payload_digest(text: Column, unit: int = WIDTH) -> Column:
    """sha256 of payload_of(text), in built-in functions."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    padding = F.greatest(F.lit(1), F.ceil(n / unit)).cast("int") * unit - n
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), padding))), 256)


def document_page(text: Column) -> Column:
    """The HTML page of a text: its first half of lines, the figure of the text's medium, and the other lines.

    The figure's caption tells how many bytes the text has. A half that is blank gives no part.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    middle = F.ceil(F.size(lines) / 2).cast("int")
    caption = F.concat(F.lit("<figcaption>"), F.octet_length(whole).cast("string"), F.lit(" bytes</figcaption>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), payload_digest(whole), F.lit('">'), caption, F.lit("</figure>"))
    first, rest = F.array_join(F.slice(lines, F.lit(1), middle), "\n"), F.array_join(F.slice(lines, middle + 1, F.size(lines)), "\n")
    return F.concat(F.lit("<article><p>"), escaped(first), F.lit("</p>"), figure, F.lit("<p>"), escaped(rest), F.lit("</p></article>"))


def document_sequences(docs: DataFrame, media: DataFrame) -> DataFrame:
    """(page, parts): the sequences of docs' pages with what media has of their payloads.

    page is struct<doc_id, n_bytes, row>, one for each row of docs. A text part's text is its length and hash, so
    that no text is shuffled.
    """
    parts = F.transform(sequence_column(document_page(F.col("text"))), lambda p: F.struct(
        p["position"].alias("position"), p["kind"].alias("kind"),
        F.when(p["text"].isNotNull(), F.concat_ws(":", F.length(p["text"]).cast("string"), F.xxhash64(p["text"]).cast("string"))).alias("text"),
        p["source"].alias("source"), p["caption"].alias("caption")))
    pages = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"), parts.alias("parts"))
    return resolve(stored(pages, "sequences").select(F.struct("doc_id", "n_bytes", "row").alias("page"), "parts"), "page", media)


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption, position, sequence) of docs' texts.

    Each text is stored losslessly as a grey image in a media table in the shared folder. The text's page, of
    its two halves with the figure of the image between them, is parsed to a sequence whose references are resolved
    against features read back from the stored images; position, caption and features are those of the sequence's
    image, and sequence is an md5 of its parts in order (kind, length and hash of text, source). Payloads are never
    shuffled: the join moves digests and features alone, and a text that many rows share is one row of it.

    Null is the empty text, whose payload is padding. Texts of any length are stored whole. Repeated rows give
    repeated rows with equal values, also where they share a doc_id; an empty table gives an empty table. Other
    columns, whatever their names, are neither read nor returned.
    """

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([png(payload_of(t)) for t in texts])

    @F.pandas_udf(FEATURES)
    def features(media: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([media_features(m) for m in media], columns=[c.split()[0] for c in FEATURES.split(", ")])

    # Media are large values: a few hundred at a time, and in small row groups, keep a task's memory low.
    with arrow_batches(docs.sparkSession, 256):
        kept = stored(docs.select(packed(F.col("text")).alias("media")), "media", **{"parquet.block.size": str(16 << 20)})
        read = kept.select(features("media").alias("f")).select("f.*")
        per_digest = stored(read.groupBy("digest").agg(*[F.first(c).alias(c) for c in read.columns[1:]]), "features")
        found = document_sequences(docs, per_digest)
    part = F.concat_ws("|", F.transform("parts", lambda p: F.concat_ws(":", p["kind"], p["text"], p["source"])))
    rows = found.select("page", F.md5(part).alias("sequence"), F.element_at(F.filter("parts", lambda p: p["kind"] == "image"), 1).alias("m"))
    return rows.select(
        "page.doc_id", "page.n_bytes", "m.payload_bytes", F.col("m.digest").alias("payload_sha256"), "m.tail_crc32", "m.media_bytes", "m.media_sha256", "m.feature",
        F.col("m.caption").alias("caption"), F.col("m.position").alias("position"), "sequence",
    )
