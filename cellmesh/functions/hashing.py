"""Hash profiles: how a key turns into columns, signs and register addresses.

A key is hashed once; columns and signs of all rows are slices of that hash where they fit it (:func:`hash_mode`).

``md5``   every engine with md5 can replay it: the default, and what SQL checks use.  The setting ``spark.cellmesh.profile`` names another default.
``xx64``  Spark's built-in 64-bit hash: fastest, stays in generated code.
``xxh3``  XXH3 with the published seed table, through an Arrow UDF: for exchange with sketches made elsewhere.

Sketches of different profiles never merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PROFILES = ("md5", "xx64", "xxh3")
CANONICAL = 5

# Seeds of the XXH3 profile, by index.
SEEDS = (
    0xCAFE3553, 0xADE3415118, 0x8CC70208, 0x2F024B2B, 0x451A3DF5,
    0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F,
    0x9B05688C, 0x1F83D9AB, 0x5BE0CD19, 0xCBBB9D5D, 0x629A292A,
    0x9159015A, 0x152FECD8, 0x67332667, 0x8EB44A87, 0xDB0C2E0D,
)


def seed(index: int) -> int:
    """The seed of an index; indexes wrap around, negative ones too."""
    return SEEDS[index % len(SEEDS)]


def text_key(key: Column) -> Column:
    return key.cast("string")


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def _digits(digest: Column, start: int) -> Column:
    """16 hex digits as the bigint with these bits."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint")  # a negative base gives signed numbers


#: The session setting that names the profile of sketches made without one.
SETTING = "spark.cellmesh.profile"


def chosen(profile: str = "") -> str:
    """A profile by name; without one that of the session's setting, or ``md5``."""
    session = None if profile else SparkSession.getActiveSession()
    name = profile or (session.conf.get(SETTING, "md5") if session else "md5")
    if name not in PROFILES:
        raise ValueError(f"no profile {name}")
    return name


# --- one hash, sliced: columns and signs of all rows ---


def bits_of(width: int) -> int:
    """Bits of a column number."""
    return max(1, (width - 1).bit_length())


def hash_mode(rows: int, cols: int) -> str:
    """``packed64`` or ``packed128`` where all rows' columns and signs fit one hash of that size, else ``rows``: a hash for each.

    Widths that are no power of two have no slices.
    """
    need = rows * (bits_of(cols) + 1)
    return "rows" if cols & (cols - 1) else "packed64" if need <= 64 else "packed128" if need <= 128 else "rows"


def words_of(key: Column, rows: int, cols: int, profile: str = "") -> list[Column]:
    """The 64-bit words that a key's columns and signs are slices of: one, the lower and the upper of two, or one a row."""
    mode, text, profile = hash_mode(rows, cols), text_key(key), chosen(profile)
    if profile == "md5":
        if mode == "rows":
            return [_digits(F.md5(F.concat(F.lit(f"{r}:"), text)), 1) for r in range(rows)]
        digest = F.md5(text)
        return [_digits(digest, 1)] if mode == "packed64" else [_digits(digest, 1), _digits(digest, 17)]
    if profile == "xx64":
        if mode == "rows":
            return [F.xxhash64(F.lit(r), text) for r in range(rows)]
        return [F.xxhash64(text)] if mode == "packed64" else [F.xxhash64(text), F.xxhash64(text, F.lit("upper"))]
    if mode == "rows":
        return [hash_it(r)(text) for r in range(rows)]
    if mode == "packed64":
        return [hash_it(0)(text)]
    both = hash128_it(0)(text)
    return [both["lo"], both["hi"]]


def column_sql(words: list[str], row: int, rows: int, cols: int) -> str:
    """The column of ``cols`` that a row's slice of :func:`words_of`, by the names of the words' columns, addresses: as SQL, which Spark reads in one go."""
    if hash_mode(rows, cols) == "rows":
        own = words[row]
        return f"cast(pmod(shiftrightunsigned({own}, 1), {cols}) as int)" if cols & (cols - 1) else f"cast({own} & {cols - 1}L as int)"
    shift = row * bits_of(cols)
    if len(words) == 1 or shift + bits_of(cols) <= 64:
        part = f"shiftrightunsigned({words[0]}, {shift})"
    elif shift >= 64:
        part = f"shiftrightunsigned({words[1]}, {shift - 64})"
    else:  # across both words
        part = f"(shiftrightunsigned({words[0]}, {shift}) | shiftleft({words[1]}, {64 - shift}))"
    return f"cast({part} & {cols - 1}L as int)"


def sign_sql(words: list[str], row: int, rows: int, cols: int) -> str:
    """+1 or -1 of a row: the bits from the top of the hash down, or the top bit of the row's own."""
    own = hash_mode(rows, cols) == "rows"
    word, bit = (words[row], 63) if own else (words[-1], 63 - row) if row < 64 else (words[0], 127 - row)
    return f"(2 * cast(shiftrightunsigned({word}, {bit}) & 1L as int) - 1)"


def derive_index(h: Column, row: int, width: int) -> Column:
    """Column in a power-of-two width: the ``row``-th slice of a 64-bit hash."""
    if width & (width - 1):
        raise ValueError("slices address power-of-two widths")
    return F.shiftrightunsigned(h, row * bits_of(width)).bitwiseAND(F.lit(width - 1)).cast("int")


def derive_sign(h: Column, row: int) -> Column:
    """Sign from bit ``63 - row``."""
    return F.when(F.shiftrightunsigned(h, 63 - row).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)


def md5_word(text: str) -> int:
    """The first 64 bits of an MD5, in Python."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def md5_columns(key: str, rows: int, cols: int) -> list[int]:
    """The columns of a key under the ``md5`` profile, in Python."""
    if hash_mode(rows, cols) == "rows":
        words = [md5_word(f"{r}:{key}") for r in range(rows)]
        return [(w >> 1) % cols if cols & (cols - 1) else w & (cols - 1) for w in words]
    raw = hashlib.md5(key.encode()).digest()
    word = int.from_bytes(raw[:8], "big") | (int.from_bytes(raw[8:], "big") << 64 if hash_mode(rows, cols) == "packed128" else 0)
    return [word >> r * bits_of(cols) & (cols - 1) for r in range(rows)]


def word_of(key: Column, profile: str = "") -> Column:
    """A key's 64-bit hash."""
    profile = chosen(profile)
    if profile == "md5":
        return _digits(F.md5(text_key(key)), 1)
    return F.xxhash64(text_key(key)) if profile == "xx64" else hash_it(CANONICAL)(text_key(key))


def words(key: Column, profile: str = "") -> tuple[Column, Column]:
    """The upper and lower 32 bits of a key's 64-bit hash, each a non-negative bigint."""
    profile = chosen(profile)
    if profile == "md5":
        digest = F.md5(text_key(key))
        return _hex(digest, 1, 8), _hex(digest, 9, 8)
    h = word_of(key, profile)
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def layer_word(key: Column, profile: str = "") -> Column:
    """32 bits of a key that none of the slices above uses, as a non-negative bigint."""
    if chosen(profile) == "md5":
        return _hex(F.md5(text_key(key)), 25, 8)
    return F.xxhash64(text_key(key), F.lit("layer")).bitwiseAND(F.lit(0xFFFFFFFF))


# --- from one 64-bit hash to those of a large matrix ---

# The golden-ratio increment and the splitmix64 multipliers.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def finalized(x: np.ndarray) -> np.ndarray:
    """A splitmix64 step of unsigned words, which wrap around."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def matrix_hash(rows: int, cols: int):
    """Arrow UDF: ``array<bigint>`` of the words that a matrix needs, derived from one 64-bit hash; null of null."""
    mode = hash_mode(rows, cols)

    def derived(h: np.ndarray) -> list[np.ndarray]:
        if mode == "packed64":
            return [h]
        if mode == "packed128":
            return [h, finalized(h ^ np.uint64(GOLDEN))]
        out = []
        for i in range(rows):
            with np.errstate(over="ignore"):
                h = finalized(h + np.uint64(i * GOLDEN & (1 << 64) - 1))
            out.append(h)
        return out

    @F.pandas_udf("array<bigint>")
    def run(hashes: pd.Series) -> pd.Series:
        known = np.flatnonzero(hashes.notna().to_numpy())
        out = np.empty(len(hashes), object)
        found = np.stack(derived(hashes.iloc[known].to_numpy(np.int64).view(np.uint64)), axis=1).view(np.int64)
        for i, words in zip(known.tolist(), found, strict=True):
            out[i] = words
        return pd.Series(out)

    return run


def float_bits(as_text: bool = True):
    """Arrow UDF: the IEEE-754 bits of a double, as an unsigned decimal number in text, or as 8 little-endian bytes."""

    def bits(values: pd.Series) -> pd.Series:
        raw = values.to_numpy(np.float64).view(np.uint64)
        out = pd.Series([str(x) if as_text else x.tobytes() for x in raw], dtype=object)
        return out.where(values.notna().to_numpy(), None)

    @F.pandas_udf("string" if as_text else "binary")
    def run(values: pd.Series) -> pd.Series:
        return bits(values)

    return run


# --- XXH3, through Arrow ---


def _xxhash():
    import xxhash

    return xxhash


def signed(x: int) -> int:
    """A 64-bit word as the bigint with the same bits."""
    return x - (1 << 64) if x >> 63 else x


def xxh3_64(data: bytes, seed_index: int = 0) -> int:
    return _xxhash().xxh3_64_intdigest(data, seed=seed(seed_index))


def xxh3_128(data: bytes, seed_index: int = 0) -> tuple[int, int]:
    """``(lo, hi)`` of XXH3-128."""
    x = _xxhash().xxh3_128_intdigest(data, seed=seed(seed_index))
    return x & ((1 << 64) - 1), x >> 64


def _bytes(key) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def _each_distinct(keys: pd.Series, f) -> tuple[list, np.ndarray]:
    """``f`` of each distinct key, and each row's number among them; -1 for null."""
    codes, values = pd.factorize(keys)
    return [f(_bytes(k)) for k in values], codes


def hash_it(seed_index: int = 0):
    """Arrow UDF: XXH3-64 of a string or binary key under a seed, as a bigint; null of null.  Each distinct key of a batch is hashed once."""

    @F.pandas_udf("bigint")
    def run(keys: pd.Series) -> pd.Series:
        found, codes = _each_distinct(keys, lambda k: signed(xxh3_64(k, seed_index)))
        table = np.array([*found, 0], np.int64)
        return pd.Series(table[codes]).astype("Int64").mask(codes < 0)

    return run


def hash64():
    return hash_it(0)


def hash128_it(seed_index: int = 0):
    """Arrow UDF: XXH3-128 as ``struct<lo, hi>``."""

    @F.pandas_udf("lo bigint, hi bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for keys in batches:
            found, codes = _each_distinct(keys, lambda k: tuple(map(signed, xxh3_128(k, seed_index))))
            table = np.array([*found, (0, 0)], np.int64)[codes]
            out = pd.DataFrame(table, columns=["lo", "hi"]).astype("Int64")
            out[codes < 0] = pd.NA
            yield out

    return run
