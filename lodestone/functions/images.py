"""Image rules and arithmetic: sizes, headers, addresses, rasters, patches."""
import ipaddress

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Limits, sizes and token ids.
MAX_PIXELS, MIN_SIDE, MAX_BYTES, MAX_SRCSET = 16_777_216, 64, 10_485_760, 2048
PATCH, POOLING, MAX_PATCHES = 16, 3, 2520
SIDE = PATCH * POOLING
LONGEST = MAX_PATCHES // (POOLING * POOLING) * SIDE
BEFORE, IMAGE_TOKEN, AFTER = [2, 255999], 258880, [258882, 1]
TYPES = ["image/jpeg", "image/png", "image/gif"]
# Address blocks by category, and what a host of a category may link to.
BLOCKS = [
    ("LOOPBACK", "127.0.0.0/8"), ("LOOPBACK", "::1/128"), ("NON_ROUTABLE", "169.254.0.0/16"), ("NON_ROUTABLE", "fe80::/10"),
    ("NON_ROUTABLE", "0.0.0.0/32"), ("NON_ROUTABLE", "::/128"), ("NON_ROUTABLE", "224.0.0.0/4"), ("NON_ROUTABLE", "ff00::/8"),
    ("PRIVATE_NETWORK", "10.0.0.0/8"), ("PRIVATE_NETWORK", "172.16.0.0/12"), ("PRIVATE_NETWORK", "192.168.0.0/16"),
    ("PRIVATE_NETWORK", "100.64.0.0/10"), ("PRIVATE_NETWORK", "fc00::/7"),
]
PERMITS = {"PUBLIC": ["PUBLIC"], "PRIVATE_NETWORK": ["PUBLIC", "PRIVATE_NETWORK"], "LOOPBACK": ["PUBLIC", "PRIVATE_NETWORK", "LOOPBACK"], "NON_ROUTABLE": ["PUBLIC", "NON_ROUTABLE"]}


def decoded_size(w: Column, h: Column) -> Column:
    return F.when(w.cast("long") * h > MAX_PIXELS, "TOO_LARGE").when(F.least(w, h) < MIN_SIDE, "TOO_SMALL").otherwise("OK")


def raster(w: Column, h: Column, data_length: Column) -> Column:
    """First broken rule of an RGB raster, or OK."""
    area = w.cast("long") * h
    return F.when((w <= 0) | (h <= 0), "NON_POSITIVE_DIMENSION").when(area > MAX_PIXELS, "TOO_MANY_PIXELS").when(data_length != area * 3, "DATA_LENGTH_MISMATCH").otherwise("OK")


def status_class(status: Column, location: Column) -> Column:
    return F.when(status.between(200, 299), "SUCCESS").when(status.between(300, 399) & location.isNotNull(), "REDIRECT").when(status.isin(408, 429) | (status >= 500), "TRANSIENT").otherwise("PERMANENT")


def header_refusal(content_type: Column, content_length: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.when(~kind.isin(TYPES), "UNSUPPORTED_TYPE").when(F.coalesce(content_length, F.lit(0)) > MAX_BYTES, "TOO_LARGE").otherwise("OK")


def ipv4_category(address: Column) -> Column:
    """Category of a dotted IPv4 address by its number."""
    octets = F.split(address, "\\.")
    number = sum((F.get(octets, i).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    out = F.when(address.isNull(), None)
    for category, block in BLOCKS:
        if ":" not in block:
            net = ipaddress.ip_network(block)
            out = out.when(number.between(int(net[0]), int(net[-1])), category)
    return out.otherwise("PUBLIC")


def category_of(address: str) -> str:
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return next((c for c, block in BLOCKS if ip in ipaddress.ip_network(block)), "PUBLIC")


@F.pandas_udf(T.StringType())
def address_category(s: pd.Series) -> pd.Series:
    """Category of an IPv4 or IPv6 address."""
    return s.map(category_of, na_action="ignore")


def permitted(categories: Column) -> Column:
    """What all of a host's addresses permit together, sorted; nothing for a host without addresses."""
    table = F.create_map(*[x for k, v in PERMITS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    sets = F.transform(categories, lambda c: table[c])
    every = F.array(*map(F.lit, sorted(PERMITS)))
    return F.when(F.size(categories) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(sets, every, F.array_intersect))


def permits_all(allowed: Column, image_categories: Column) -> Column:
    return (F.size(image_categories) > 0) & F.forall(image_categories, lambda c: F.array_contains(allowed, c))


def target_size(w: Column, h: Column) -> Column:
    """struct(width, height): aspect kept within the patch budget, sides multiples of 48."""
    factor = F.sqrt(F.lit(float(MAX_PATCHES * PATCH * PATCH)) / (w.cast("double") * h))
    floor = lambda x: (F.floor(x / SIDE) * SIDE).cast("int")
    long = lambda a, b: F.least((F.floor(a.cast("double") / b) * SIDE), F.lit(LONGEST)).cast("int")
    sw, sh = floor(factor * w), floor(factor * h)
    return F.struct(F.when(sw == 0, SIDE).when(sh == 0, long(w, h)).otherwise(sw).alias("width"), F.when(sw == 0, long(h, w)).when(sh == 0, SIDE).otherwise(sh).alias("height"))


def patch_grid(w: Column, h: Column) -> Column:
    """struct(patches, tokens) of a raster of target size."""
    cols, rows = F.floor(w / PATCH).cast("int"), F.floor(h / PATCH).cast("int")
    return F.struct((cols * rows).alias("patches"), (F.floor(cols / POOLING) * F.floor(rows / POOLING)).cast("int").alias("tokens"))


def input_ids(tokens: Column) -> Column:
    return F.concat(F.array(*map(F.lit, BEFORE)), F.array_repeat(F.lit(IMAGE_TOKEN), tokens), F.array(*map(F.lit, AFTER)))


def exclusion(classes: Column, width: Column, height: Column, url: Column) -> Column:
    """First rule that excludes an image of a post, or KEPT."""
    def small(c):
        px = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), "^([0-9]{1,9})$", 1)
        return F.coalesce(F.when(px != "", px).cast("int") < MIN_SIDE, F.lit(False))
    emoji = F.arrays_overlap(F.split(F.coalesce(classes, F.lit("")), "\\s+"), F.array(F.lit("emoji"), F.lit("wp-smiley")))
    return F.when(emoji, "EMOJI").when(small(width) | small(height), "TOO_SMALL").when(~F.coalesce(url.rlike("(?i)^https://[^/?#]"), F.lit(False)), "NOT_HTTPS").otherwise("KEPT")


def srcset_choice(srcset: Column) -> Column:
    """Address of the widest candidate of at most 2048 pixels, the first of equal ones; null where none has a width."""
    found = F.regexp_extract_all(F.concat(srcset, F.lit(",")), F.lit("([^\\s,]\\S*)\\s+([0-9]{1,9})w\\s*,"), F.lit(0))
    each = F.transform(found, lambda m, i: F.struct(F.regexp_extract(m, "\\s([0-9]{1,9})w", 1).cast("int").alias("w"), (-i).alias("at"), F.regexp_extract(m, "^(\\S+)", 1).alias("url")))
    return F.array_max(F.filter(each, lambda x: x["w"] <= MAX_SRCSET))["url"]


def _weights(size: int, out: int) -> list[tuple[int, np.ndarray]]:
    """First input place and 22-bit weights of each output place, for bicubic resampling with a = -0.5."""
    scale = size / out
    wide = 2.0 * max(scale, 1.0)
    rows = []
    for k in range(out):
        centre = (k + 0.5) * scale
        lo, hi = max(0, int(centre - wide + 0.5)), min(size, int(centre + wide + 0.5))
        x = np.abs((np.arange(lo, hi) - centre + 0.5) / max(scale, 1.0))
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
        w = w / w.sum()
        rows.append((lo, np.where(w < 0, np.ceil(w * (1 << 22) - 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)))
    return rows


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic resize of a (rows, columns, 3) raster of bytes: columns first, then rows, in fixed point."""
    def along(x: np.ndarray, out: int) -> np.ndarray:
        got = np.empty((x.shape[0], out, x.shape[2]), np.uint8)
        for k, (lo, w) in enumerate(_weights(x.shape[1], out)):
            got[:, k] = np.clip((np.tensordot(x[:, lo : lo + len(w)].astype(np.int64), w, ([1], [0])) + (1 << 21)) >> 22, 0, 255)
        return got
    x = pixels if pixels.shape[1] == width else along(pixels, width)
    return x if x.shape[0] == height else along(x.transpose(1, 0, 2), height).transpose(1, 0, 2)


def patchify(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2520, 768) patches of values in 0..1 and their (column, row) places; padding is 0 at place -1."""
    rows, cols = pixels.shape[0] // PATCH, pixels.shape[1] // PATCH
    patches, places = np.zeros((MAX_PATCHES, PATCH * PATCH * 3), np.float32), np.full((MAX_PATCHES, 2), -1, np.int64)
    x = pixels[: rows * PATCH, : cols * PATCH].reshape(rows, PATCH, cols, PATCH, 3).transpose(0, 2, 1, 3, 4).reshape(rows * cols, -1)
    patches[: len(x)] = x.astype(np.float32) / 255
    places[: len(x)] = np.stack([np.tile(np.arange(cols), rows), np.repeat(np.arange(rows), cols)], 1)
    return patches, places
