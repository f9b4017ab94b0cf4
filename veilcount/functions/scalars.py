"""Column functions: classes, ratios, signed counts, names and formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Port classes, the least cells of an active circuit, and the modulus of blinded counts.
WEB_PORTS = (80, 443)
INTERACTIVE_PORTS = (22, 194, 994, 6660, 6661, 6662, 6663, 6664, 6665, 6666, 6667, 6668, 6669, 6670, 6679, 6697, 7000)
P2P_PORTS = (1214, 6699, 45682, 51413)
P2P_RANGES = ((4661, 4666), (6346, 6429), (6881, 6999))
ACTIVE_CELLS = 8
MODULUS = 2**70
#: The ratio where nothing came in, and where nothing went out.
RATIO_NO_INBOUND, RATIO_NO_OUTBOUND = 1024.0, -1021.0


def whole(n: int) -> Column:
    """An integer literal beyond 64 bits."""
    return F.lit(str(n)).cast("decimal(38,0)")


def port_class(port: Column) -> Column:
    """Web, Interactive, P2P or OtherPort; the first that matches."""
    p2p = port.isin(*P2P_PORTS)
    for low, high in P2P_RANGES:
        p2p = p2p | port.between(low, high)
    return F.when(port.isin(*WEB_PORTS), "Web").when(port.isin(*INTERACTIVE_PORTS), "Interactive").when(p2p, "P2P").otherwise("OtherPort")


def web_class(port: Column) -> Column:
    """F2."""
    return F.when(port.isin(*WEB_PORTS), "Web").otherwise("NonWeb")


def encode_ratio(inbound: Column, outbound: Column) -> Column:
    """log2(out / in), with finite values at the ends."""
    return F.when((inbound == 0) & (outbound == 0), 0.0).when(inbound == 0, RATIO_NO_INBOUND).when(outbound == 0, RATIO_NO_OUTBOUND).otherwise(F.log2(outbound.cast("double") / inbound))


def is_active(inbound: Column, outbound: Column) -> Column:
    """F4."""
    return inbound + outbound >= ACTIVE_CELLS


def cell_count(*counts: Column) -> Column:
    """the largest of several counts of one thing, 0 where all are missing."""
    return F.greatest(F.lit(0), *[F.coalesce(c, F.lit(0)) for c in counts])


def gaps(times: Column) -> Column:
    """the differences of sorted times."""
    s = F.array_sort(times)
    return F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) - F.get(s, i - 1))).otherwise(F.array().cast("array<double>"))


IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
IPV6 = r"(?i)^(?=.*:)(([0-9a-f]{1,4}:){7}([0-9a-f]{1,4}|:)|:(:[0-9a-f]{1,4}){7}|(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)$"


def plain_ipv6(address: Column) -> Column:
    """An IPv6 address whose last 32 bits are written as IPv4 (RFC 4291, 2.2.3), in groups of hex digits alone."""
    tail = F.regexp_extract(address, r"^[0-9A-Fa-f:]*:([0-9.]+)$", 1)
    number = F.lpad(F.hex(ipv4_number(tail)), 8, "0")
    groups = F.concat(F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4))
    return F.when(tail.rlike(IPV4), F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), groups)).otherwise(address)


def ip_version(address: Column) -> Column:
    """4, 6 or null."""
    return F.when(address.rlike(IPV4), 4).when(address.rlike(IPV6), 6).when(F.contains(address, F.lit(":")) & plain_ipv6(address).rlike(IPV6), 6)


def ipv4_number(address: Column) -> Column:
    """The address as an integer, null where it isn't IPv4."""
    part = F.split(address, r"\.")
    return F.when(address.rlike(IPV4), sum(F.get(part, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(4)))


def ipv4_digits(number: Column) -> Column:
    """An IPv4 address, given as an integer, in hex digits."""
    return F.lower(F.lpad(F.hex(number.cast("long")), 8, "0"))


def _ipv6_digits(address: Column) -> Column:
    """An IPv6 address of groups of hex digits alone, without its gap."""
    halves = F.split(F.lower(address), "::")
    groups = lambda i: F.coalesce(F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda x: x != ""), F.array().cast("array<string>"))
    digits = lambda i: F.array_join(F.transform(groups(i), lambda g: F.lpad(g, 4, "0")), "")
    low = digits(1)
    return F.concat(F.rpad(digits(0), 32 - F.length(low), F.lit("0")), low)


def address_digits(address: Column) -> Column:
    """the address as 8 (IPv4) or 32 (IPv6) hex digits in lower case, null where it is neither.

    Texts of one length sort as the numbers do, beyond 64 bits too; unhex() makes 16 bytes of them.
    """
    dotted = F.contains(address, F.lit("."))
    plain = F.when(dotted & F.contains(address, F.lit(":")), plain_ipv6(address)).otherwise(address)
    # Bound once: a lambda's variable isn't worked out anew wherever it is named.
    long = F.get(F.transform(F.array(plain), lambda a: F.when(a.rlike(IPV6), _ipv6_digits(a))), F.lit(0))
    return F.when(address.rlike(IPV4), ipv4_digits(ipv4_number(address))).when(F.contains(address, F.lit(":")), long)


def network_digits(digits: Column, prefix: Column, last: bool = False) -> Column:
    """The first (or last) address of the network of so many bits that the address lies in, as hex digits."""
    whole, rest = F.floor(prefix / 4).cast("int"), F.pmod(prefix, F.lit(4)).cast("int")
    host = F.element_at(F.array(*[F.lit(2 ** (4 - i) - 1) for i in range(4)]), rest + 1)  # bits of the digit that is cut
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.lower(F.hex((digit.bitwiseOR(host) if last else digit - digit.bitwiseAND(host)).cast("long")))
    head = F.concat(F.substr(digits, F.lit(1), whole), F.when(rest > 0, cut).otherwise(""))
    return F.rpad(head, F.length(digits), F.lit("f" if last else "0"))


def is_network(address: Column, prefix: Column, strict: bool = True) -> Column:
    """whether address/prefix is a network; a strict one has no bits set beyond the prefix."""
    digits = address_digits(address)
    ok = prefix.between(0, F.length(digits) * 4)
    if strict:
        ok = ok & (network_digits(digits, prefix) == digits)
    return F.coalesce(ok, F.lit(False))


def host_class(requested: Column) -> Column:
    """F8: how the destination was asked for."""
    version = ip_version(requested)
    return F.when(version == 4, "IPv4Literal").when(version == 6, "IPv6Literal").otherwise("Hostname")


def is_domain(name: Column) -> Column:
    """F9."""
    return F.coalesce(name.rlike(r"(?i)^[a-z0-9._-]+$"), F.lit(False))


def is_country(code: Column) -> Column:
    return F.coalesce(code.rlike(r"(?i)^([a-z0-9]{2}|\?\?|!!)$"), F.lit(False))


def is_as_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\+?0*[1-9]\d*\s*$"), F.lit(False))


def is_reason(text: Column) -> Column:
    """letters and digits, as reasons of failures and of cache events are written."""
    return F.coalesce(text.rlike(r"(?i)^[a-z0-9]+\z"), F.lit(False))


def onion_name(text: Column) -> Column:
    """the name in an onion address or URL: its host's last label but 'onion', in lower case."""
    after = F.when(F.instr(text, ":") > 0, F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)
    host = F.get(F.filter(F.split(after, "/"), lambda x: x != ""), F.lit(0))
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: (x != "") & (x != "onion"))
    return F.try_element_at(labels, F.lit(-1))


def is_onion(name: Column) -> Column:
    """a 16-character base32 name, or the MD5 of one."""
    return F.coalesce(name.rlike(r"(?i)^([a-z2-7]{16}|[0-9a-f]{32})$"), F.lit(False))


def onion_md5(name: Column) -> Column:
    """F12."""
    return F.md5(F.concat(F.lower(name), F.lit(".onion")).cast("binary"))


def unblind(share: Column, modulus: int = MODULUS) -> Column:
    """what cancels a blinding share."""
    return (whole(modulus) - share) % whole(modulus)


def signed(count: Column, modulus: int = MODULUS) -> Column:
    """F16: counts from the upper half of the modulus are negative."""
    return F.when(count < whole((modulus + 1) // 2), count).otherwise(count - whole(modulus))


#: Seconds of each unit.
UNITS = (("w", 604800), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1))


def period(seconds: Column) -> Column:
    """'1w 3d 12h 20m 32s'; a larger unit brings all smaller ones along."""
    left, shown = F.abs(seconds.cast("long")), []
    for name, size in UNITS:
        part = F.floor((left % (size * {"w": 10**9, "d": 7, "h": 24, "m": 60, "s": 60}[name])) / size)
        shown.append(F.when((left >= size) | F.lit(name == "s"), F.concat(part.cast("string"), F.lit(name))))
    return F.concat(F.when(seconds <= -1, "-").otherwise(""), F.concat_ws(" ", *shown))


def moment(seconds: Column) -> Column:
    """'2024-01-31 23:59:59 UTC', whatever the session's time zone; parts of a second are cut off."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("long").cast("decimal(18,6)"))
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def at_time(elapsed: Column, what: str, seconds: Column) -> Column:
    """'1m 5s (since 2024-01-31 23:59:59 UTC 1706745599)'."""
    return F.concat(period(elapsed), F.lit(f" ({what} "), moment(seconds), F.lit(" "), seconds.cast("long").cast("string"), F.lit(")"))


def size_text(n: Column) -> Column:
    """1024-based, one place; negative sizes stay in bytes."""
    out = F.when(n < 1024, F.concat(F.format_string("%.1f", n.cast("double")), F.lit(" B")))
    for name, least in (("kB", 1024), ("MB", 1024**2)):
        out = out.when(n < least * 1024, F.concat(F.format_string("%.1f", n.cast("double") / least), F.lit(f" {name}")))
    return out.otherwise(F.concat(F.format_string("%.1f", n.cast("double") / 1024**3), F.lit(" GB")))


def shortened(text: Column, most: int = 100, ellipsis: str = "...") -> Column:
    """at most so many characters, with the ellipsis in the middle; an odd one goes to the start."""
    left = most - len(ellipsis)
    start, end = F.substring(text, 1, max(left + 1, 0) // 2), F.right(text, F.lit(max(left, 0) // 2))
    cut = F.concat(start, F.lit(ellipsis), end) if left > 0 else F.lit(ellipsis[:most])
    return F.when(F.length(text) <= most, text).otherwise(cut)


def list_summary(first: Column, last: Column, n: Column, most: int = 50, ellipsis: str = "....") -> Column:
    """a list by its first and last item, at most so long each, and its length; null items are of no list."""
    one = shortened(first.cast("string"), most, ellipsis)
    both = F.concat(first.cast("string"), F.lit(ellipsis), last.cast("string"))
    shown = F.when(n > 1, shortened(both, 2 * most + len(ellipsis), ellipsis)).when(n == 1, one).otherwise("")
    return F.concat(F.lit("'"), shown, F.lit("' ("), n.cast("string"), F.lit(")"))


def listed(items: Column, most: int = 50, ellipsis: str = "....") -> Column:
    """an aggregate, the summary of a group's items in order; no list of them is gathered."""
    return list_summary(F.min(items), F.max(items), F.count(items), most, ellipsis)


def json_text(data: Column) -> Column:
    """compact JSON; nulls are kept."""
    return F.to_json(data, {"ignoreNullFields": "false"})


def encoded(data: Column) -> Column:
    """the compact JSON in base64."""
    return F.base64(json_text(data).cast("binary"))


def decoded(text: Column, schema: str) -> Column:
    """what encoded() has encoded; null where it isn't that."""
    return F.from_json(F.try_to_binary(text, F.lit("base64")).cast("string"), schema)


def safe_divide(a: Column, b: Column) -> Column:
    """0 over a zero divisor."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """F22."""
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def needs_delay(before: Column, proposed: Column, tolerance: float) -> Column:
    """noise that falls by more than the tolerance."""
    return proposed < before - tolerance


def tolerance_floor() -> float:
    """what doubles and their printed forms can't tell apart."""
    return math.ulp(1.0) / 2 + 1e-14
