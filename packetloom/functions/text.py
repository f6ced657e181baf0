"""Payload, HTTP and domain-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Request methods recognised by the URI extractor and by the request test.
URI_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT"]
REQUEST_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH"]

REPLACEMENT = "�"


def utf8_text(payload: Column) -> Column:
    """Decode bytes as UTF-8, dropping what does not decode."""
    return F.replace(F.make_valid_utf8(payload.cast("string")), F.lit(REPLACEMENT), F.lit(""))


def ascii_text(payload: Column) -> Column:
    """Decode bytes as ASCII, dropping every byte above 0x7f."""
    return F.regexp_replace(F.decode(payload, "ISO-8859-1"), "[^\\x00-\\x7f]", "")


def byte_text(payload: Column) -> Column:
    """One character per byte, for byte-wise searches."""
    return F.decode(payload, "ISO-8859-1")


def _form_unquote(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _percent_unquote(text: Column) -> Column:
    return _form_unquote(F.replace(text, F.lit("+"), F.lit("%2B")))


def deep_url_decode(text: Column, rounds: int = 3) -> Column:
    """Percent-decode then form-decode, repeated; rounds after the fixpoint change nothing.

    A percent sign not followed by two hex digits stays as it is.
    """
    for _ in range(rounds):
        text = _form_unquote(_percent_unquote(text))
    return text


def label_entropy(label: Column) -> Column:
    """Shannon entropy in bits of the letters and digits of a label, case folded."""
    cleaned = F.regexp_replace(F.lower(label), "[^\\p{L}\\p{N}]", "")
    size = F.length(cleaned)

    def term(ch: Column) -> Column:
        p = (size - F.length(F.replace(cleaned, ch, F.lit("")))) / size
        return -p * F.log2(p)

    total = F.aggregate(F.array_distinct(F.split(cleaned, "")), F.lit(0.0), lambda acc, ch: acc + term(ch))
    return F.when(size > 0, total).otherwise(F.lit(0.0))


def base_domain(qname: Column) -> Column:
    """Last two labels; a single label is returned unchanged."""
    trimmed = F.rtrim(qname, F.lit("."))
    return F.when(F.contains(trimmed, F.lit(".")), F.substring_index(trimmed, ".", -2)).otherwise(qname)


def http_uri(payload: Column) -> Column:
    """URI of the request line, NULL when the first line is not a request."""
    words = F.split(F.trim(F.substring_index(utf8_text(payload), "\r\n", 1)), "\\s+")
    return F.when(F.upper(F.get(words, F.lit(0))).isin(URI_METHODS), F.get(words, F.lit(1)))


def http_headers(payload: Column) -> Column:
    """array<struct<k, v>> of the header lines up to the first empty line; keys lower-cased."""
    lines = F.split(utf8_text(payload), "\r\n")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    end = F.array_position(body, "")
    head = F.when(end > 0, F.slice(body, F.lit(1), (end - 1).cast("int"))).otherwise(body)
    with_colon = F.filter(head, lambda line: F.contains(line, F.lit(":")))
    return F.transform(
        with_colon,
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("k"),
            F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("v"),
        ),
    )


def header_value(headers: Column, key: str) -> Column:
    """Value of the last header with this key."""
    return F.try_element_at(F.filter(headers, lambda h: h["k"] == key.lower()), F.lit(-1))["v"]


def is_http_request(text: Column) -> Column:
    return text.rlike("^(" + "|".join(REQUEST_METHODS) + ") ")


def hex_dump(frame: Column, limit: int = 256) -> Column:
    """array<struct<offset, hex, ascii>>, sixteen bytes per line, of the first ``limit`` bytes."""
    head = F.substring(frame, 1, limit)
    size = F.length(head)

    def line(start: Column) -> Column:
        chunk = F.substring(head, start + 1, F.lit(16))
        pairs = F.rtrim(F.regexp_replace(F.lower(F.hex(chunk)), "(..)", "$1 "))
        printable = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), "[^ -~]", ".")
        return F.struct(
            F.lpad(F.lower(F.hex(start)), 4, "0").alias("offset"),
            F.rpad(pairs, 47, " ").alias("hex"),
            printable.alias("ascii"),
        )

    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, line)


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.2f MB", n / float(1024**2)))
        .otherwise(F.format_string("%.2f GB", n / float(1024**3)))
    )


def hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    )
