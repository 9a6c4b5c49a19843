"""URL, address and media-type rules as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions import ship_by_value
from tallymark.functions.text import strip

ship_by_value(__name__)

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _host_and_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")


def url_host(url: Column) -> Column:
    """Lower-case host without port, brackets and final dots; '' when there is none."""
    part = _host_and_port(url)
    bracketed = F.regexp_extract(part, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(part, "^([^:]*)", 1)
    host = F.when(part.startswith("["), bracketed).otherwise(plain)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def url_port_text(url: Column) -> Column:
    return F.regexp_extract(_host_and_port(url), r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def url_problem(url: Column) -> Column:
    """Why a URL is refused before its host is looked up, NULL when it is not."""
    host, port = url_host(url), url_port_text(url)
    bad_port = (port != "") & ~F.coalesce(
        port.rlike("^[0-9]+$") & port.try_cast("bigint").between(0, 65535), F.lit(False)
    )
    return (
        F.when(
            url.isNull() | ~url_scheme(url).isin("http", "https") | (host == ""),
            F.lit("file_url must be a valid HTTP/HTTPS URL"),
        )
        .when((host == "localhost") | host.endswith(".localhost"), F.lit("file_url host is not allowed"))
        .when(bad_port, F.lit("invalid file_url port"))
    )


def file_name(url: Column) -> Column:
    last = F.substring_index(url_path(url), "/", -1)
    return F.left(F.coalesce(F.nullif(last, F.lit("")), F.lit(K.DEFAULT_FILE_NAME)), F.lit(K.MAX_FILE_NAME))


def clean_mime(content_type: Column) -> Column:
    return F.lower(strip(F.split_part(content_type, F.lit(";"), F.lit(1))))


def mime_by_extension(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)$", 1))
    pairs = [F.lit(text) for item in K.EXTENSION_MIME.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), extension)


def mime_by_content(content: Column) -> Column:
    """Media type from the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), F.lit("application/pdf"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image/webp"))
        .otherwise(F.lit("application/octet-stream"))
    )


def media_type(content_type: Column, url: Column, content: Column) -> Column:
    declared = clean_mime(F.coalesce(content_type, F.lit("")))
    guessed = F.coalesce(mime_by_extension(url_path(url)), mime_by_content(content))
    return F.when(declared.isin(*K.VAGUE_MIME_TYPES), guessed).otherwise(declared)


def data_url(content: Column, name: Column) -> Column:
    """Bytes as a data URL; base64 comes in lines, which a URL must not have."""
    mime = F.coalesce(mime_by_extension(name), F.lit(K.DEFAULT_ROW_IMAGE_MIME))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def _octets(address: Column) -> Column:
    """IPv4 address as a number, NULL for anything else."""
    plain = F.split_part(address, F.lit("%"), F.lit(1))
    parts = F.split(plain, r"\.")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total * 256 + part.try_cast("bigint"))
    return F.when(plain.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


_MAPPED = "0" * 20 + "ffff"


def address_key(address: Column) -> Column:
    """An address as 32 hexadecimal digits, which sort as the addresses do; IPv4 ones as
    mapped into IPv6. NULL for anything else. A zone after % is left out."""
    plain = F.lower(F.split_part(address, F.lit("%"), F.lit(1)))
    v4 = F.concat(F.lit(_MAPPED), F.lpad(F.lower(F.hex(_octets(plain))), 8, "0"))
    # A dotted end becomes two groups.
    tail = F.regexp_extract(plain, r"^(?:.*:)([0-9.]*\.[0-9.]*)$", 1)
    last = F.lpad(F.lower(F.hex(_octets(tail))), 8, "0")
    grouped = F.when(tail == "", plain).otherwise(
        F.concat(F.left(plain, F.length(plain) - F.length(tail)), F.left(last, F.lit(4)), F.lit(":"), F.right(last, F.lit(4)))
    )
    sides = F.split(grouped, "::")

    def groups(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    given = F.size(left) + F.size(right)
    fits = F.when(F.size(sides) == 1, given == 8).otherwise((F.size(sides) == 2) & (given <= 7))
    good = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))

    def spelled(side: Column) -> Column:
        return F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")

    v6 = F.concat(spelled(left), F.repeat(F.lit("0000"), 8 - given), spelled(right))
    return F.when(plain.contains(":"), F.when(fits & good, v6)).otherwise(v4)


def _address_steps() -> tuple[list[str], list[bool]]:
    """The address space as stretches: the key each begins at, in order, and whether its
    addresses are globally reachable."""

    def blocks(v4: tuple[str, ...], v6: tuple[str, ...]) -> list[tuple[int, int]]:
        found = []
        for text in (*v4, *v6):
            network = ipaddress.ip_network(text)
            base = int(_MAPPED, 16) << 32 if network.version == 4 else 0
            found.append((base + int(network.network_address), base + int(network.broadcast_address)))
        return found

    mapped = ipaddress.ip_network("::ffff:0:0/96")
    reserved = blocks(K.RESERVED_IPV4, tuple(text for text in K.RESERVED_IPV6 if ipaddress.ip_network(text) != mapped))
    reachable = blocks(K.REACHABLE_IPV4, K.REACHABLE_IPV6)
    edges = {0} | {edge for low, high in (*reserved, *reachable) for edge in (low, high + 1) if edge < 1 << 128}
    inside = lambda point, ranges: any(low <= point <= high for low, high in ranges)
    ordered = sorted(edges)
    return [f"{edge:032x}" for edge in ordered], [not inside(e, reserved) or inside(e, reachable) for e in ordered]


def is_global(address: Column) -> Column:
    """Whether an address is globally reachable; false for what is none. The key is looked
    up among the starts of the stretches by halving, so no row meets all of them."""
    starts, verdicts = _address_steps()
    strides = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    key = address_key(address)

    def place(key: Column) -> Column:
        return F.aggregate(
            F.lit(strides), F.lit(0), lambda at, far: F.when(F.get(F.lit(starts), at + far) <= key, at + far).otherwise(at)
        )

    found = F.get(F.transform(F.array(key), lambda k: F.when(k.isNotNull(), F.get(F.lit(verdicts), place(k)))), F.lit(0))
    return F.coalesce(found, F.lit(False))
