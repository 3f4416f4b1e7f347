"""Column functions on messages, headers and payload values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token rules.
EMPTY_WORDS = ["nil", "none", "null"]
PART_STOP_WORDS = ["http", "https", "json", "true", "false"]
HTML_STARTS = ["<!doctype html", "<html", "<head", "<body", "<meta ", "<div ", "<script", "<style"]
HTML_MARKERS = ["<!doctype html", "<html", "<head", "<body", "<meta ", "<script", "<style", "</div>", "</html>"]
HTML_CLOSING = r"</(div|html|body|script|style|span|table)>"
IDENTIFIER_KEYS = ["id", "name", "username", "userid", "hotelid", "reservationid"]


def endpoint_host(col: Column) -> Column:
    """The text before the last colon; all of it without one."""
    return F.regexp_replace(col, r":[^:]*$", "")


def conn_key(a: Column, b: Column) -> Column:
    """Both endpoints in one order, whichever way a message went."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def is_loopback(host: Column) -> Column:
    return host.startswith("127.") | (host == "localhost") | (host == "::1")


def trace_context(headers: Column) -> Column:
    """(trace_id, span_id, parent_span_id) from a header map, by priority of header; names match in any case."""
    h = F.transform_keys(headers, lambda k, _: F.lower(k))
    clean = lambda c: F.trim(F.regexp_replace(c, r"(\\r|\\n|\r|\n)", ""))
    get = lambda name: F.nullif(clean(F.element_at(h, F.lit(name))), F.lit(""))
    parts = F.split(get("uber-trace-id"), ":")
    uber = F.size(parts) >= 3
    parent = F.get(parts, F.lit(2))
    nothing = F.lit(None).cast("string")
    mark = F.coalesce(get("x-mark"), get("x_mark"))
    b3 = get("x-b3-traceid")
    row = lambda t, s, p: F.struct(t.alias("trace_id"), s.alias("span_id"), p.alias("parent_span_id"))
    return (
        F.when(uber, row(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.when(parent != "0", parent)))
        .when(mark.isNotNull(), row(mark, nothing, nothing))
        .when(b3.isNotNull(), row(b3, get("x-b3-spanid"), get("x-b3-parentspanid")))
        .otherwise(row(F.coalesce(get("x-trace-id"), get("x-request-id")), nothing, nothing))
    )


def network_duration_us(out_us: Column, in_us: Column) -> Column:
    return F.abs(out_us - in_us)


def unique_keep_order(items: Column) -> Column:
    """Distinct items in order of first appearance."""
    return F.array_distinct(items)


def normalize_value(col: Column) -> Column:
    """Trimmed and lower-cased; empty for the words of nothing; decimals with three places."""
    v = F.lower(F.trim(col))
    number = F.format_string("%.3f", v.cast("double"))
    return F.when(v.isin(EMPTY_WORDS), "").when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), number).otherwise(v)


def is_html_noise(col: Column) -> Column:
    """Pages rather than values: a page's opening, two page marks, or a long text with closing tags."""
    v = F.lower(F.trim(col))
    opens = F.exists(F.array(*map(F.lit, HTML_STARTS)), lambda s: F.startswith(v, s))
    marks = F.size(F.filter(F.array(*map(F.lit, HTML_MARKERS)), lambda s: F.contains(v, s)))
    return F.coalesce(opens | (marks >= 2) | ((F.char_length(v) > 1000) & v.rlike(HTML_CLOSING)), F.lit(False))


def derived_tokens(value: Column) -> Column:
    """``p:`` parts of two characters or more and ``n:`` numbers of three to eight digits, sorted."""
    parts = F.filter(F.split(value, "[^a-z0-9]+"), lambda p: (F.char_length(p) >= 2) & ~p.isin(PART_STOP_WORDS))
    numbers = F.transform(F.filter(parts, lambda p: p.rlike("^[a-z]*[0-9]{3,8}$")), lambda p: F.concat(F.lit("n:"), F.regexp_extract(p, "([0-9]{3,8})$", 1)))
    return F.array_sort(F.array_distinct(F.concat(F.transform(parts, lambda p: F.concat(F.lit("p:"), p)), numbers)))


def filter_db_result_tokens(req: Column, res: Column) -> Column:
    """Result tokens that the request has, that repeat a value it asked for, or that name a business identifier."""
    asked = F.transform(
        F.filter(req, lambda t: t.rlike("^(kv:.*=|v:|d:)")),
        lambda t: F.when(t.startswith("kv:"), F.regexp_replace(t, "^[^=]*=", "")).otherwise(F.regexp_replace(t, "^[vd]:", "")),
    )
    key = lambda t: F.regexp_extract(t, "^kv:([^=]*)=", 1)
    value = lambda t: F.regexp_replace(t, "^[^=]*=", "")
    pair = lambda t: t.rlike("^kv:[^=]*=")
    named = lambda t: (F.endswith(key(t), F.lit("id")) | key(t).isin(IDENTIFIER_KEYS)) & ~value(t).rlike("^[0-9a-f]{24,32}$")
    kept = F.filter(res, lambda t: F.array_contains(req, t) | (pair(t) & (F.array_contains(asked, value(t)) | named(t))))
    return F.when((F.size(req) > 0) & (F.size(res) > 0), F.array_sort(kept)).otherwise(F.array().cast("array<string>"))


def merge_weights(a: Column, b: Column) -> Column:
    """Two token-weight maps as one, the larger weight where both have a token."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, y), F.coalesce(y, x)))


def decay_weights(weights: Column, factor: float, floor: float = 1e-9) -> Column:
    """Weights times a factor, those at the floor or below dropped."""
    return F.map_filter(F.transform_values(weights, lambda _, w: w * factor), lambda _, w: w > floor)


def mark_of(attributes: Column, url: Column) -> Column:
    """The mark of a row: the JSON attribute x_mark, else the URL's rid parameter, decoded."""
    rid = F.nullif(F.regexp_extract(url, r"[?&]rid=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.nullif(F.get_json_object(attributes, "$.x_mark"), F.lit("")), F.try_url_decode(rid))


def first_url(data: Column) -> Column:
    """The first ``url`` field of a payload (an object or a list), else its first 200 characters."""
    found = F.coalesce(F.get_json_object(data, "$.url"), F.get_json_object(data, "$[0].url"), F.nullif(F.regexp_extract(data, r'"url"\s*:\s*"([^"]*)"', 1), F.lit("")))
    return F.coalesce(found, F.substring(data, 1, 200))
