"""Column functions: text, base64, hashes, keys, numbers and times.

All are expressions of built-in functions and stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 32 bits.
FNV_START, FNV_PRIME = 2166136261, 16777619


def text_of(binary: Column) -> Column:
    """Binary as text; null where it is not valid UTF-8."""
    text = binary.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def bytes_of(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def base64_of(binary: Column) -> Column:
    """Standard base64 without line breaks, whatever the session's setting."""
    return F.regexp_replace(F.base64(binary), r"[\r\n]", "")


def base64_to_bytes(text: Column) -> Column:
    """Decoded base64; null where the text is no base64."""
    return F.try_to_binary(text, F.lit("base64"))


def nanos_key(nanos: Column) -> Column:
    """Nanoseconds as 19 digits, so that texts order like numbers; null for negative ones, which would not."""
    return F.when(nanos >= 0, F.lpad(nanos.cast("string"), 19, "0"))


def path_key(*parts: Column | str) -> Column:
    """Parts joined by a slash; null if one is, where ``concat_ws`` would skip it."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    joined = columns[0]
    for c in columns[1:]:
        joined = F.concat(joined, F.lit("/"), c)
    return joined


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a text, as a long; the empty text gives the start value."""
    data = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    byte = lambda i: F.conv(F.substring(data, 2 * i - 1, 2), 16, 10).cast("long")
    fold = F.aggregate(F.sequence(F.lit(1), size), F.lit(FNV_START).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME).cast("long")) % F.lit(1 << 32))
    return F.when(size > 0, fold).otherwise(F.lit(FNV_START).cast("long"))


def partition_of(text: Column, n: int) -> Column:
    """Partition of a key among ``n``."""
    return (fnv1a_32(text) % n).cast("int")


def operation_of(text: Column) -> Column:
    """``put`` or ``delete``, folding case and blanks; null for anything else."""
    op = F.lower(F.trim(text))
    return F.when(op.isin("get", "put", "delete"), op)


def uint32_of(text: Column) -> Column:
    """A decimal number below 2**32 as a long; null for anything else."""
    n = F.when(text.rlike("^[0-9]{1,10}$"), text).cast("long")
    return F.when(n < (1 << 32), n)


def bool_of(text: Column) -> Column:
    """The usual spellings of true and false; null for anything else."""
    return F.when(text.isin("1", "t", "T", "true", "TRUE", "True"), F.lit(True)).when(text.isin("0", "f", "F", "false", "FALSE", "False"), F.lit(False))


def floats_of(text: Column) -> Column:
    """A list of numbers parted by commas; null where one is no number."""
    numbers = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def nanos_of_rfc3339(text: Column) -> Column:
    """Nanoseconds of a time like 2024-01-02T03:04:05.123456789Z; null if it is no such time.

    Timestamps end at microseconds; so whole seconds and the fraction are read apart.
    """
    form = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"
    part = lambda k: F.regexp_extract(text, form, k)
    seconds = F.unix_seconds(F.concat(part(1), part(3)).try_cast("timestamp"))
    fraction = F.rpad(part(2), 9, "0").cast("long")
    return F.when(text.rlike(form), seconds * F.lit(1_000_000_000).cast("long") + fraction)


def path_unescape(text: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with ``prefix``; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
