"""Image objects of a document: predicates, decoding, deduplication, re-encoding."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from foliospark.functions import deflate, images, jpeg, jpeg_decode
from foliospark.functions.predictor import encode_png_best
from foliospark.operators.graph import rewritten
from foliospark.sources.pdf import Document
from foliospark.sources.pdfsyntax import Name, PdfError, Ref, Stream, decoded, filters_of

EDGE, QUALITY, SMALL = 1920, 62, 80 * 80
_PIXEL_CODECS = ("DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode")


def integer(d: dict, key: str) -> int | None:
    v = d.get(key)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def is_image(d: dict) -> bool:
    return d.get("Subtype") == "Image" or all(k in d for k in ("Width", "Height", "BitsPerComponent"))


def is_skipped(d: dict, soft_mask: bool) -> bool:
    """Stencils, colour-keyed images and soft masks are left alone."""
    return d.get("ImageMask") is True or isinstance(d.get("Mask"), list) or soft_mask


def leaf_filter(d: dict) -> str | None:
    f = filters_of(d)
    return f[-1] if f else None


def flate_eligible(d: dict) -> bool:
    """Whether a stream may be deflated anew: not if its only filter is Flate, nor after an image codec."""
    f = d.get("Filter")
    if f is None:
        return True
    if isinstance(f, Name):
        return f in ("LZWDecode", "ASCII85Decode", "ASCIIHexDecode")
    return isinstance(f, list) and not any(x in _PIXEL_CODECS for x in f if isinstance(x, Name))


def components(doc: Document, d: dict) -> int | None:
    """Samples a pixel of a colour space as its name says: one for gray, three for any other, none (None) for
    DeviceCMYK. Indexed samples and profiles of one channel so turn out too short and are passed over."""
    c = doc.get(d.get("ColorSpace"))
    if isinstance(c, list):
        return 1 if c and c[0] in ("DeviceGray", "CalGray") else 3
    return 1 if c in ("DeviceGray", "DeviceGrey") else None if c == "DeviceCMYK" else 3


def soft_masks(doc: Document) -> dict[int, int]:
    """Soft masks by number, with how many objects refer to each."""
    out: dict[int, int] = {}
    for v in doc.objects.values():
        d = v.dict if isinstance(v, Stream) else v
        if isinstance(d, dict) and isinstance(m := d.get("SMask"), Ref):
            out[m.num] = out.get(m.num, 0) + 1
    return out


class Image(NamedTuple):
    num: int
    width: int
    height: int
    rgb: bytes
    skip_reason: str | None
    original_len: int


def decode(doc: Document, num: int, soft_mask: bool) -> Image:
    """The pixels of an image object, or the first reason to pass it over."""
    s = doc.objects[num]
    width, height = integer(s.dict, "Width") or 0, integer(s.dict, "Height") or 0

    def skipped(reason: str) -> Image:
        return Image(num, width, height, b"", reason, len(s.data))

    if is_skipped(s.dict, soft_mask):
        return skipped("stencil or gray mask")
    if width <= 0 or height <= 0:
        return skipped("bad dimensions")
    f = leaf_filter(s.dict)
    if f == "DCTDecode":
        return _from_jpeg(doc, s, num, width, height) or skipped("jpeg decode failed")
    if f in _PIXEL_CODECS:
        return skipped("unsupported filter")
    n = components(doc, s.dict)
    try:
        data = doc.data(s)
    except PdfError:
        data = b""
    if n is None or (integer(s.dict, "BitsPerComponent") or 8) != 8 or len(data) < width * height * n:
        return skipped("raw decode failed")
    samples = np.frombuffer(data, np.uint8)[: width * height * n].reshape(-1, n)
    return Image(num, width, height, (samples if n == 3 else samples.repeat(3, 1)).tobytes(), None, len(s.data))


def _from_jpeg(doc: Document, s: Stream, num: int, width: int, height: int) -> Image | None:
    """The pixels of a JPEG stream, whose size must be the one its dictionary states."""
    try:
        w, h, channels, data = jpeg_decode.decode(_before_codec(doc, s))
    except (ValueError, PdfError):
        return None
    rgb = data if channels == 3 else np.frombuffer(data, np.uint8).repeat(3).tobytes()
    reason = None if (w, h) == (width, height) else "pixel size mismatch"
    return Image(num, width, height, rgb if reason is None else b"", reason, len(s.data))


def _before_codec(doc: Document, s: Stream) -> bytes:
    """A stream's data through its filters but for the last."""
    f = doc.resolved(s.dict.get("Filter"))
    return decoded(Stream({"Filter": f[:-1]}, s.data)) if isinstance(f, list) and len(f) > 1 else s.data


def image_stream(d: dict, width: int, height: int, data: bytes, codec: str, parms: dict | None = None) -> Stream:
    kept = {k: v for k, v in d.items() if k not in ("Decode", "DecodeParms")}
    new = {"Width": width, "Height": height, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name(codec)}
    return Stream(kept | new | ({"DecodeParms": parms} if parms else {}), data)


def recompressed(image: Image, d: dict) -> Stream | None:
    """A shorter stream of the image: as JPEG, else for small ones as filtered and deflated rows."""
    w, h = images.fit(image.width, image.height, EDGE)
    rgb = image.rgb
    if (w, h) != (image.width, image.height):
        rgb = images.resize(np.frombuffer(rgb, np.uint8).reshape(image.height, image.width, 3), w, h).tobytes()
    data = jpeg.encode_rgb(w, h, rgb, QUALITY, subsample=True)
    if len(data) < image.original_len:
        return image_stream(d, w, h, data, "DCTDecode")
    if w * h <= SMALL:
        data = deflate.compress(encode_png_best(rgb, w * 3, 3))
        if len(data) < image.original_len:
            return image_stream(d, w, h, data, "FlateDecode", {"Predictor": 15, "Colors": 3, "BitsPerComponent": 8, "Columns": w})
    return None


def gray_samples(doc: Document, s: Stream, w: int, h: int) -> bytes | None:
    """The samples of a gray image of 8 bits, from a JPEG its first channel; None where they can't be had."""
    try:
        if leaf_filter(s.dict) == "DCTDecode":
            jw, jh, channels, data = jpeg_decode.decode(_before_codec(doc, s))
            data = data[::channels] if (jw, jh) == (w, h) else b""
        else:
            data = doc.data(s) if (integer(s.dict, "BitsPerComponent") or 8) == 8 else b""
    except (ValueError, PdfError):
        return None
    return data if w > 0 and h > 0 and len(data) >= w * h else None


def synced_mask(doc: Document, d: dict, width: int, height: int, uses: dict[int, int]) -> tuple[int, Stream] | bool:
    """The soft mask at an image's new size; True where there is none, False where it can't follow."""
    m = d.get("SMask")
    if not isinstance(m, Ref):
        return True
    s = doc.objects.get(m.num)
    if not isinstance(s, Stream) or uses.get(m.num, 0) > 1:
        return False
    w, h = integer(s.dict, "Width") or 0, integer(s.dict, "Height") or 0
    data = gray_samples(doc, s, w, h)
    if data is None:
        return False
    gray = images.resize(np.frombuffer(data, np.uint8)[: w * h].reshape(h, w, 1), width, height).tobytes()
    kept = {k: v for k, v in s.dict.items() if k != "DecodeParms"}
    return m.num, Stream(kept | {"Width": width, "Height": height, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, deflate.compress(gray))


@dataclass
class ImageStats:
    rewritten: int = 0
    deduped: int = 0
    skipped: int = 0
    rows: list[Image] = field(default_factory=list)


def process(doc: Document) -> ImageStats:
    """Merges equal images into the one of the least number, and shortens the rest where that is possible.

    Images are equal if their size, pixels and soft mask are.
    """
    masks, stats = soft_masks(doc), ImageStats()
    found = [decode(doc, n, n in masks) for n in sorted(doc.objects) if isinstance(doc.objects[n], Stream) and is_image(doc.objects[n].dict)]
    stats.rows = found
    first: dict[tuple, int] = {}
    to: dict[int, int] = {}
    for i in found:
        if i.skip_reason:
            stats.skipped += 1
        elif (kept := first.setdefault((images.fingerprint(i.rgb, i.width, i.height), doc.objects[i.num].dict.get("SMask")), i.num)) != i.num:
            to[i.num] = kept
    if to:
        doc.objects = {n: rewritten(v, to) for n, v in doc.objects.items() if n not in to}
        stats.deduped = len(to)
    uses = soft_masks(doc)
    for i in found:
        if i.skip_reason or i.num in to:
            continue
        d = doc.objects[i.num].dict
        new = recompressed(i, d)
        if new is None:
            continue
        if (new.dict["Width"], new.dict["Height"]) != (i.width, i.height):
            mask = synced_mask(doc, d, new.dict["Width"], new.dict["Height"], uses)
            if mask is False:
                continue
            if mask is not True:
                doc.objects[mask[0]] = mask[1]
        doc.objects[i.num] = new
        stats.rewritten += 1
    return stats


def reflate(doc: Document) -> int:
    """Deflates the streams that get shorter by it; returns how many."""
    n = 0
    for num, s in doc.objects.items():
        if not isinstance(s, Stream) or is_image(s.dict) or not flate_eligible(s.dict):
            continue
        try:
            raw = doc.data(s)
        except PdfError:
            continue
        if not raw or (len(s.data) > 64 and len(raw) < 16):
            continue
        data = deflate.compress(raw)
        if len(data) < len(s.data):
            doc.objects[num] = Stream({k: v for k, v in s.dict.items() if k != "DecodeParms"} | {"Filter": Name("FlateDecode")}, data)
            n += 1
    return n
