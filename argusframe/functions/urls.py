"""Targets and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from argusframe.functions.text import trim_space

# What an admitted address may not be.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0")
BLOCKED_PREFIXES = ("192.168.", "10.", "172.")
BLOCKED_SUFFIX = ".local"
CODE_HOSTS = ("github.com", "www.github.com")
ARCHIVE_SUFFIX = ".zip"
ARCHIVE_MAX_BYTES = 50 * 1024 * 1024


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once a row, however often ``then`` names it. An expression that is only repeated in
    branches is worked out in each of them, and those nest here."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def classify_target(target: Column) -> Column:
    """``web`` for an http(s) address or anything that begins like
    ``label.tld``, else ``code``."""
    looks_web = target.rlike(r"(?i)^https?://") | target.rlike(r"(?i)^[a-z0-9][-a-z0-9]*\.[a-z]{2,}")
    return F.when(looks_web, "web").otherwise("code")


def normalize_url(target: Column) -> Column:
    url = trim_space(target)
    has_scheme = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.regexp_replace(F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url)), r"/+\z", "")


def http_counterpart(url: Column) -> Column:
    return F.regexp_replace(url, "^https://", "http://")


def _with_scheme(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("http")), text).otherwise(F.concat(F.lit("https://"), text))


# scheme, slashes, optional user part, host, optional port, then path, query or end
_ADDRESS = r"(?i)^https?:[/\\]*(?:[^/\\?#]*@)?((?:[^/\\?#:@\s<>^|%\[\]]|%[0-9a-f]{2})+|\[[0-9a-f:.]+\])(?::([0-9]*))?(?:([/\\][^?#]*)|[?#]|\z)"


def url_host(url: Column) -> Column:
    """Lower-cased host, null when the address cannot be read. Addresses that
    begin ``http`` but hold no scheme are invalid."""
    def of(address: Column) -> Column:
        host, port = F.regexp_extract(address, _ADDRESS, 1), F.regexp_extract(address, _ADDRESS, 2)
        usable = lambda p: (p == "") | (p.try_cast("decimal(38,0)") <= 65535)
        return _once(host, lambda h: F.when((h != "") & F.coalesce(_once(port, usable), F.lit(False)), _canonical_host(F.lower(h))))

    return _once(url, of)


def _canonical_host(host: Column) -> Column:
    """``host`` with percent codes decoded and, where its last part is a number,
    as four decimal parts: ``127.1``, ``2130706433`` and ``0x7f.0.0.1`` are all
    ``127.0.0.1``. Null where that is no host."""
    def number(part: Column) -> Column:
        digits = F.when(part.rlike(r"^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10)) \
            .when(part.rlike(r"^0[0-7]+$"), F.conv(part, 8, 10)).when(part.rlike(r"^(?:0|[1-9][0-9]*)$"), part)
        return digits.try_cast("bigint")

    def dotted(values: Column) -> Column:
        n = F.size(values)
        last = F.element_at(values, -1)
        head = F.slice(values, F.lit(1), n - 1)
        fits = (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & F.forall(head, lambda v: v <= 255) & (last < F.pow(F.lit(256), 5 - n))
        total = F.aggregate(F.transform(head, lambda v, i: v * F.pow(F.lit(256), 3 - i).cast("bigint")), last, lambda a, v: a + v)
        quad = lambda t: F.concat_ws(".", *[F.shiftright(t, bits).bitwiseAND(F.lit(255)).cast("string") for bits in (24, 16, 8, 0)])
        return F.when(fits, _once(total, quad))

    def of(plain: Column) -> Column:
        parts = F.split(F.regexp_replace(plain, r"\.\z", ""), r"\.")
        is_number = lambda ps: F.element_at(ps, -1).rlike(r"^(?:[0-9]+|0x[0-9a-f]*)$")
        return _once(parts, lambda ps: F.when(is_number(ps), _once(F.transform(ps, number), dotted)).otherwise(plain))

    decoded = lambda h: F.when(F.contains(h, F.lit("%")), F.lower(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))))).otherwise(h)
    clean = lambda p: F.when(~p.rlike(r"[/\\?#:@\s<>^|%]") | F.startswith(p, F.lit("[")), p)
    return _once(host, lambda h: _once(decoded(h), lambda p: _once(clean(p), of)))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _ADDRESS, 3)


def admit_url(target: Column) -> Column:
    """``struct(admitted, reason)`` for a site to be scanned."""
    def reason_of(host: Column) -> Column:
        private = host.isin(*BLOCKED_HOSTS) | F.endswith(host, F.lit(BLOCKED_SUFFIX))
        for prefix in BLOCKED_PREFIXES:
            private = private | F.startswith(host, F.lit(prefix))
        return F.when(host.isNull(), "invalid url").when(private, "private address")

    host = _once(trim_space(target), lambda text: url_host(_with_scheme(text)))
    return _once(_once(host, reason_of), lambda reason: F.struct(reason.isNull().alias("admitted"), reason.alias("reason")))


def canonical_repo(target: Column) -> Column:
    """``struct(owner, repo, reason)`` of a repository address."""
    text = F.regexp_replace(F.regexp_replace(trim_space(target), r"\.git\z", ""), r"/+\z", "")
    parts_of = lambda address: F.split(F.regexp_replace(url_path(address), r"^[/\\]+", ""), r"[/\\]")

    def judged(host: Column, parts: Column) -> Column:
        owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        missing = (F.coalesce(owner, F.lit("")) == "") | (F.coalesce(repo, F.lit("")) == "")
        reason = (
            F.when(host.isNull(), "invalid url")
            .when(~host.isin(*CODE_HOSTS), "unsupported host")
            .when(missing, "owner and repository required")
        )
        clean = lambda part, why: F.when(why.isNull(), F.regexp_replace(part, r"[^a-zA-Z0-9_.-]", ""))
        return _once(reason, lambda why: F.struct(clean(owner, why).alias("owner"), clean(repo, why).alias("repo"), why.alias("reason")))

    address = _once(text, _with_scheme)
    return _once(address, lambda a: _once(url_host(a), lambda host: _once(parts_of(a), lambda parts: judged(host, parts))))


def admit_archive(name: Column, size: Column) -> Column:
    """``struct(admitted, reason)`` for an uploaded archive."""
    reason = (
        F.when(~F.endswith(name, F.lit(ARCHIVE_SUFFIX)), "not a zip archive")
        .when(size > ARCHIVE_MAX_BYTES, "archive too large")
    )
    return F.struct(reason.isNull().alias("admitted"), reason.alias("reason"))
