"""Media columns: interleaved sequences of text and media references.

Pages are parsed into ordered segments; each media segment names its payload by
digest, and the payload's features are joined by that digest, so a payload that
many pages use is stored and measured once per task that writes it and joined
once. Positions and captions stay with their segment.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import join_spread, parts, shared_dir, written

#: Samples in a row of the stored image; digests that a storing task remembers.
WIDTH, SEEN = 192, 200_000
SEGMENT = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
MEDIA = "digest string, media binary, n long"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Elements whose content is no text of the page, and void elements that break a line.
HIDDEN, UNREAD = {"script", "style", "nav", "noscript", "template"}, {"script", "style"}
BREAKS = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "td", "th", "dt", "dd", "option", "article", "section", "figure"}


class _Interleaved(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.buf: list[str] = []
        #: Open hidden elements, what has come since the outermost was opened, and whether that is read after all.
        self.hidden: list[str] = []
        self.kept: list[tuple] = []
        self.released = False
        #: Open figures: the media segments and the caption of each; the text of an open caption.
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.buf).split(" ")).strip(" \n\t\r"):
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "ref": None, "caption": None})
        self.buf = []

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in HIDDEN and not (self.released and tag not in UNREAD):
            if self.hidden:
                self.kept.append((self.handle_starttag, tag, attrs))
            if tag in HIDDEN:
                self.hidden.append(tag)
            return
        a = dict(attrs)
        if tag in ("img", "video", "audio", "source") and a.get("src"):
            self.flush()
            self.out.append({"pos": len(self.out), "kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt")})
            if self.figures:
                self.figures[-1]["media"].append(self.out[-1])
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in BREAKS:
            self.buf.append("\n")
            if tag == "figure":
                self.figures.append({"media": [], "caption": None})

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)
            if tag == "figure":
                self.handle_endtag(tag)

    def end_caption(self) -> None:
        """An open caption becomes its figure's, or text where there is no figure."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if self.figures and self.figures[-1]["caption"] is None:
            self.figures[-1]["caption"] = text
        else:
            self.buf.append(f"\n{text}\n")

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        for segment in figure["media"]:
            segment["caption"] = segment["caption"] if figure["caption"] is None else figure["caption"]
        if figure["caption"] and not figure["media"]:
            self.buf.append(f"\n{figure['caption']}\n")

    def handle_endtag(self, tag):
        if self.hidden:
            self.kept.append((self.handle_endtag, tag))
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
                if not self.hidden:
                    self.kept = []
        elif tag == "figcaption":
            self.end_caption()
        elif tag in BREAKS:
            if tag == "figure" and self.figures:
                self.end_figure()
            self.buf.append("\n")

    def handle_data(self, data):
        if self.hidden:
            if self.hidden[-1] not in UNREAD:
                self.kept.append((self.handle_data, data))
        else:
            (self.buf if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        """The segments at the page's end; what an element hid that was never closed is read after all."""
        self.close()
        if self.hidden and self.hidden[0] not in UNREAD:
            kept, self.kept, self.hidden, self.released = self.kept, [], [], True
            for handler, *what in kept:
                handler(*what)
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()
        return self.out


def interleave(page: str | None) -> list[dict]:
    """Ordered text and media segments of a page; a figure's caption goes to the media of that figure.

    Without a figure's caption, media have their own description. A caption of no
    figure, or of one without media, is text. A null or empty page has no
    segments. Broken markup is read as far as it goes: an element that hides its
    content (navigation, templates) hides none if it is never closed or closes
    itself; scripts and styles are never read.
    """
    parser = _Interleaved()
    parser.feed(page or "")
    return parser.finish()


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes with bytes 32 up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def to_media(payload: bytes) -> bytes:
    """A binary grey map: 8-bit samples, 192 to a row, as they are."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a grey map; a broken header or length is an error."""
    magic, size, top, body = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(body) != width * height:
        raise ValueError("not an 8-bit grey map")
    return body


def feature_of(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and a 64-bit difference hash of 8 x 9 cell means."""
    a = np.frombuffer(payload, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean * mean)))
    edges = np.linspace(0, len(a), 73).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(a, dtype=np.int64)))
    cells = ((total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"rows={len(a) // WIDTH};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};dhash={bits}"


def store_media(payloads: DataFrame, path: str) -> DataFrame:
    """Write the payloads (digest, payload binary) as media to ``path``; returns (digest, media, n).

    A task writes a digest's bytes once, as far as it remembers (SEEN digests);
    other rows of a digest, here or in other tasks, may have equal bytes again, so
    readers take one row per digest. ``n`` sums up to a digest's payloads.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}

        def more() -> pd.DataFrame:
            rows = [(d, n) for d, n in seen.items() if n]
            return pd.DataFrame([(d, None, n) for d, n in rows], columns=["digest", "media", "n"], dtype=object)

        for pdf in parts(batches):
            out = []
            for digest, payload in zip(pdf["digest"], pdf["payload"], strict=True):
                if digest in seen:
                    seen[digest] += 1
                else:
                    seen[digest] = 0
                    out.append((digest, to_media(bytes(payload)), 1))
            yield pd.DataFrame(out, columns=["digest", "media", "n"], dtype=object)
            if len(seen) >= SEEN:
                yield more()
                seen = {}
        yield more()
    return written(payloads.mapInPandas(put, MEDIA), path)


def media_features(media: DataFrame) -> DataFrame:
    """Read stored media back and measure them; one row per digest."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            out = []
            for digest, stored in zip(pdf["digest"], pdf["media"], strict=True):
                stored = bytes(stored)
                payload = from_media(stored)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])
    return media.where("media IS NOT NULL").select("digest", "media").mapInPandas(measure, FEATURES).dropDuplicates(["digest"])


def interleaved(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, segments) of every page; null pages have no segments."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            yield pd.DataFrame({"id": pdf["id"], "segments": [interleave(h) for h in pdf["html"]]})
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, f"id {kind}, segments {SEGMENT}")


def resolve(sequences: DataFrame, features: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Segments of (id, segments), one row each, with the features of the media they name by ``sha256:`` digest.

    ``counts`` has (digest, n), how many segments name a digest; it is counted
    where it is not given. Segments that name none have the empty digest.
    """
    names = [c for c in sequences.columns if c != "segments"]
    rows = sequences.select(*names, F.inline("segments"))
    rows = rows.withColumn("digest", F.coalesce(F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1), F.lit("")))
    counts = rows.groupBy("digest").agg(F.count("*").alias("n")) if counts is None else counts
    return join_spread(rows, features, "digest", counts, "id", "left")


def page_segments(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, text, ref, caption: every segment of every page, in order within it."""
    rows = interleaved(pages, "page_id", "html").select(F.col("id").alias("page_id"), F.inline("segments"))
    return rows.select("page_id", F.col("pos").alias("position"), "kind", "text", "ref", "caption")


def text_media(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every document's text as a stored grey map, found again through a page whose figure names it by digest.

    The page has a heading before the figure and a note after it. A null text is
    empty and has a payload of one row of spaces. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            payloads = [payload_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"digest": [hashlib.sha256(p).hexdigest() for p in payloads], "payload": payloads})

    def page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                digest = hashlib.sha256(payload_of(text)).hexdigest()
                n = len((text or "").encode("utf-8", "surrogatepass"))
                mark = f'<h1>{doc_id}</h1><figure><img src="sha256:{digest}"><figcaption>{n} bytes</figcaption></figure><p>stored</p>'
                out.append((None if doc_id is pd.NA else int(doc_id), n, interleave(mark)))
            rows = pd.DataFrame(out, columns=["id", "n_bytes", "segments"])
            rows["id"] = rows["id"].astype("Int64")
            yield rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    media = store_media(rows.select("text").mapInPandas(pack, "digest string, payload binary"), f"{path}/media")
    pages = rows.mapInPandas(page, f"id long, n_bytes long, segments {SEGMENT}")
    figures = pages.withColumn("segments", F.filter("segments", lambda x: x["kind"] == "media"))
    counts = media.groupBy("digest").agg(F.sum("n").alias("n"))
    return resolve(figures, media_features(media), counts).select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("position"), "caption"
    )
