"""Images of books: format and size from their headers, and whether they may be kept as they are.

No imaging library is at hand, so pictures are not scaled; those that would be are marked.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

#: Longest edge and bytes up to which an image is kept as it is.
EDGE, BYTES = 1400, 300_000


def probe(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG, GIF or JPEG; None for anything else."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 + size
    return None


def probed(images: DataFrame) -> DataFrame:
    """images: path, content. Adds format, width, height and keep: small enough to stay as it is."""

    def run(frames):
        import pandas as pd

        for f in frames:
            got = [probe(bytes(c) if c is not None else None) for c in f["content"]]
            rows = [(p, *(g or (None, None, None)), bool(g) and max(g[1:]) <= EDGE and len(c) <= BYTES) for p, g, c in zip(f["path"], got, f["content"])]
            yield pd.DataFrame(rows, columns=["path", "format", "width", "height", "keep"]).astype({"width": "Int64", "height": "Int64"})

    return images.select("path", "content").mapInPandas(run, "path string, format string, width long, height long, keep boolean")
