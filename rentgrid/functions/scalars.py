"""Cleaning and derivation functions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentgrid.functions import constants as K

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often it is used.

    Columns are trees: a value used twice is written twice into the plan, and a parse
    of text is then run for every place that reads it. A lambda's variable is not.
    """
    return F.transform(F.array(value), use)[0]


def missing_if_nan(c: ColumnLike) -> Column:
    """NaN and infinities are missing values, so they become NULL."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: ColumnLike) -> Column:
    """Text to double; the guard rejects suffixes such as ``12d`` that a cast accepts."""
    t = F.trim(col(text))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def parse_price(text: ColumnLike) -> Column:
    """``'$1,234.00'`` to 1234.0; anything that is no number becomes NULL."""
    return to_number(F.regexp_replace(col(text).cast("string"), r"[\s$,]", ""))


# --- quotes -------------------------------------------------------------------

QUOTE_SCHEMA = ("quote struct<total_price:string,raw_price_line_items:"
                "array<struct<amount:string,item_type:string,description:string>>>")


def parse_quote(raw: ColumnLike) -> Column:
    return F.from_json(col(raw), QUOTE_SCHEMA)


def quote_items(raw: ColumnLike) -> Column:
    """``struct(gross, discount)`` of the quoted period.

    Gross is the total plus the negative line items; subtotals after discount are
    skipped. A malformed quote, or an amount that is no number, gives NULLs.
    """
    def items(q: Column) -> Column:
        listed = F.coalesce(q["raw_price_line_items"], F.array().cast(
            "array<struct<amount:string,item_type:string,description:string>>"))
        counted = F.filter(listed, lambda i: ~F.coalesce(i["item_type"] == "discounted_subtotal", F.lit(False)))
        amounts = F.transform(counted, lambda i: to_number(i["amount"]))
        discount = F.aggregate(amounts, F.lit(0.0), lambda acc, a: acc - F.when(
            a.isNull(), None).otherwise(F.least(a, F.lit(0.0))))
        return F.struct(to_number(q["total_price"]).alias("total"), discount.alias("discount"))

    def known(i: Column) -> Column:
        valid = i["total"].isNotNull() & i["discount"].isNotNull()
        return F.struct(F.when(valid, i["total"] + i["discount"]).alias("gross"),
                        F.when(valid, i["discount"]).alias("discount"))

    return bound(bound(parse_quote(raw)["quote"], items), known)


def quote_features(raw: ColumnLike, check_in: ColumnLike, check_out: ColumnLike) -> Column:
    """``struct(nights, gross_price, discount_share)`` of a quote."""
    nights = F.date_diff(col(check_out).cast("date"), col(check_in).cast("date")).cast("long")
    return bound(quote_items(raw), lambda q: F.struct(
        nights.alias("nights"),
        F.when(nights > 0, q["gross"] / nights).alias("gross_price"),
        F.when(q["gross"] > 0, q["discount"] / q["gross"]).alias("discount_share")))


def quote_item(raw: ColumnLike, description: str) -> Column:
    """Amount of the first line item with this description."""
    items = parse_quote(raw)["quote"]["raw_price_line_items"]
    hit = F.filter(items, lambda i: i["description"] == description)
    return to_number(F.try_element_at(hit, F.lit(1))["amount"])


# --- listing text ---------------------------------------------------------------

def bathrooms(number: ColumnLike, text: ColumnLike) -> Column:
    t = F.lower(F.trim(col(text)))
    found = F.nullif(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    half = F.when(t.contains("half"), F.lit(0.5))
    return F.coalesce(missing_if_nan(col(number).cast("double")), found, half)


def shared_bath(text: ColumnLike) -> Column:
    return F.lower(col(text)).contains("shared")


def parse_items(raw: ColumnLike) -> Column:
    """JSON list to array; invalid JSON gives NULL (see ``item_count``)."""
    return F.from_json(col(raw), "array<string>")


def item_count(raw: ColumnLike) -> Column:
    return F.coalesce(F.size(F.filter(parse_items(raw), lambda x: x.isNotNull())), F.lit(0)).cast("long")


def item_flags(raw: ColumnLike, patterns: Mapping[str, str] = K.AMENITY_PATTERNS) -> list[Column]:
    """One boolean per pattern: some item of the list matches it."""
    items = parse_items(raw)

    def some_item(pattern: str) -> Column:
        return F.exists(items, lambda x: x.rlike("(?i)" + pattern))

    return [F.coalesce(some_item(p), F.lit(False)).alias(name) for name, p in patterns.items()]


def licence_status(text: ColumnLike) -> Column:
    t = F.trim(col(text))
    return (F.when(F.lower(t) == "exempt", "isenta")
            .when(F.upper(t).startswith("OSE-STRREG"), "registrada")
            .when(t.isNull() | (t == ""), "ausente")
            .otherwise("outra"))


def property_group(prop: ColumnLike, room: ColumnLike) -> Column:
    """Seven groups; earlier rules win, an unknown wording falls back to the room type."""
    p = F.lower(F.trim(F.coalesce(col(prop), F.lit(""))))
    apartment = p.rlike(K.APARTMENT_WORDS)
    fallback = F.create_map(*[F.lit(x) for kv in K.GROUP_BY_ROOM_TYPE.items() for x in kv])
    return (F.when(p.startswith("shared room"), "quarto_compartilhado")
            .when(p.rlike(K.HOTEL_WORDS), "hotel_pousada")
            .when(p.rlike(K.UNUSUAL_WORDS), "atipico")
            .when(p.startswith("private room") & apartment, "quarto_em_apartamento")
            .when(p.startswith("private room"), "quarto_em_casa")
            .when(p.startswith("entire") & apartment, "apartamento_inteiro")
            .when(p.startswith("entire") | p.isin("tiny home", "casa particular"), "casa_inteira")
            .otherwise(F.coalesce(F.try_element_at(fallback, col(room)), F.lit("atipico"))))


def tf_bool(c: ColumnLike) -> Column:
    return F.when(col(c) == "t", True).when(col(c) == "f", False)


def false_if_null(c: ColumnLike) -> Column:
    return F.coalesce(col(c), F.lit(False))


# --- time -------------------------------------------------------------------------

def host_years(years: ColumnLike, months: ColumnLike) -> Column:
    return col(years).cast("double") + col(months).cast("double") / 12


def days_since(date: ColumnLike, reference: ColumnLike | None = None) -> Column:
    return F.date_diff(col(reference).cast("date"), col(date).cast("date")).cast("long")


def months_since(date: ColumnLike, reference: ColumnLike) -> Column:
    return days_since(date, reference) / F.lit(K.DAYS_PER_MONTH)


# --- occupancy ----------------------------------------------------------------------

def stay_nights(min_nights: ColumnLike, stay: float = K.MEAN_STAY) -> Column:
    """max(stay, minimum); ``greatest`` would skip a NULL minimum, here it stays NULL."""
    n = col(min_nights).cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(float(stay)), n))


def occupancy_model(rate: ColumnLike, min_nights: ColumnLike, idle_days: ColumnLike,
                    stay: float = K.MEAN_STAY, window: int | None = K.ACTIVE_DAYS) -> Column:
    """Share of the year occupied, from reviews per month."""
    monthly = F.coalesce(col(rate).cast("double"), F.lit(0.0))
    share = monthly / K.REVIEW_RATE * 12 * stay_nights(min_nights, stay) / 365
    share = F.when(share.isNotNull(), F.least(share, F.lit(K.OCCUPANCY_CAP)))
    if window is None:
        return share
    active = F.coalesce(col(idle_days) <= window, F.lit(False))
    return F.when(active, share).otherwise(F.lit(0.0))


def occupancy_nights(reviews: ColumnLike, min_nights: ColumnLike) -> Column:
    nights = F.bround(col(reviews) / F.lit(K.REVIEW_RATE) * stay_nights(min_nights), 0)
    return F.when(nights.isNotNull(), F.least(nights, F.lit(float(K.NIGHTS_CAP)))).cast("long")


def review_rate(n: ColumnLike, first: ColumnLike, scraped: ColumnLike) -> Column:
    """Reviews per 30 days since the first one, at least one month."""
    days = days_since(first, scraped)
    return F.when(days.isNotNull(), col(n) / F.greatest(F.lit(1.0), (days + 1) / F.lit(30.0)))


def naive_review_rate(n: ColumnLike, first: ColumnLike, scraped: ColumnLike) -> Column:
    months = days_since(first, scraped) / F.lit(K.DAYS_PER_MONTH)
    return F.try_divide(col(n).cast("double"), months)


def is_long_stay(min_nights: ColumnLike, nights: int = K.LONG_STAY_NIGHTS) -> Column:
    return col(min_nights) >= nights


def is_multi_host(listings: ColumnLike) -> Column:
    return col(listings) > 1


def stratum_label(long_stay: ColumnLike) -> Column:
    return F.when(col(long_stay), "30+ noites").otherwise("< 30 noites")


# --- codes ------------------------------------------------------------------------------

def in_bbox(lat: ColumnLike, lon: ColumnLike, box: Sequence[float] = K.BBOX) -> Column:
    west, south, east, north = box
    return F.coalesce(col(lat).between(south, north) & col(lon).between(west, east), F.lit(False))


def normalise_zip(c: ColumnLike) -> Column:
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"^\s*(\d{5})", 1), F.lit(""))


def clean_sentinels(c: ColumnLike) -> Column:
    """Survey value; blanks, text and negative codes are missing."""
    x = to_number(col(c).cast("string"))
    return F.when(x >= 0, x)


def code_in_vintage(code: ColumnLike, vintage: ColumnLike, moved: Mapping[str, Mapping[str, str]]) -> Column:
    """Area code as it was in a vintage, e.g. ``{'2019': {'116': '105'}}``."""
    out = col(code)
    for v, mapping in moved.items():
        for new, old in mapping.items():
            out = F.when((col(vintage) == v) & (col(code) == new), F.lit(old)).otherwise(out)
    return out


def ordinal(c: ColumnLike, domain: Sequence[str]) -> Column:
    """0-based place in the domain, -1 when unknown or missing."""
    place = F.array_position(F.array(*[F.lit(x) for x in domain]), col(c)) - 1
    return F.coalesce(place, F.lit(-1)).cast("long")


def bool_to_num(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Boolean features as 0/1 doubles; the control flags in ``keep`` stay boolean."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name)
        if f.dataType.typeName() == "boolean" and f.name not in keep else F.col(f.name)
        for f in df.schema.fields])


def bucket(c: ColumnLike, edges: Sequence[float | None], labels: Sequence[str],
           null_label: str | None = None) -> Column:
    """Right-closed bands; ``None`` as an outer edge means unbounded."""
    x, out = col(c), F.lit(null_label).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = x.isNotNull()
        if low is not None:
            inside = inside & (x > low)
        if high is not None:
            inside = inside & (x <= high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def publish_coordinate(c: ColumnLike) -> Column:
    return F.round(col(c), 4)


def constant_price(price: ColumnLike, gross: ColumnLike, first_period: ColumnLike, factor: ColumnLike) -> Column:
    """Comparable price: deflated in the first period, gross (else quoted) in the second."""
    return F.when(col(first_period), col(price) * col(factor)).otherwise(
        F.coalesce(col(gross), col(price)))


# --- vintages ------------------------------------------------------------------------------

def vintage(df: DataFrame, which: str, suffixes: Mapping[str, str], features: Sequence[str],
            keys: Sequence[str], deflate: Mapping[str, Column] | None = None) -> DataFrame:
    """Select one vintage of every feature under its neutral name.

    A feature stored once keeps its column; a feature stored per vintage is read
    from ``<feature><suffix>``. ``deflate`` maps monetary features to their factor.
    """
    if which not in suffixes:
        raise ValueError(f"unknown vintage {which!r}; have {sorted(suffixes)}")
    out = []
    for f in features:
        source = f + suffixes[which]
        c = F.col(source if source in df.columns else f)
        if deflate and f in deflate:
            c = c * deflate[f]
        out.append(c.alias(f))
    return df.select(*keys, *out)


def index_factor(series: DataFrame, frm: str, to: str | None, target: str | None = None) -> DataFrame:
    """One row ``(factor, month)`` from a monthly ``(month, value)`` series.

    ``YYYY-MM`` must exist exactly; ``YYYY`` is the mean of exactly twelve months.
    Without ``to`` the target is ``target`` or, failing that, the last month before
    it. A missing month raises when the row is read; nothing is interpolated.
    """
    month, value = F.col("month"), F.col("value").cast("double")

    def level(period: str) -> Column:
        if len(period) == 4:
            inside = month.startswith(period + "-")
            n = F.count_if(inside & value.isNotNull())
            return F.when(n == 12, F.avg(F.when(inside, value))).otherwise(
                F.raise_error(F.lit(f"year {period} has no twelve months")))
        found = F.max(F.when(month == period, value))
        return F.coalesce(found, F.raise_error(F.lit(f"month {period} is missing")).cast("double"))

    if to is not None:
        end, label = level(to), F.lit(to)
    else:
        usable = value.isNotNull() & ((month <= target) if target else F.lit(True))
        end = F.max_by(F.when(usable, value), F.when(usable, month))
        label = F.max(F.when(usable, month))
        end = F.coalesce(end, F.raise_error(F.lit("no month at or before the target")).cast("double"))
    return series.agg((end / level(frm)).alias("factor"), label.alias("month"))


def nullsafe_close(a: ColumnLike, b: ColumnLike) -> Column:
    """Equal within ``1e-8 + 1e-5 |b|``; two missing values agree."""
    x, y = col(a).cast("double"), col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, F.abs(x - y) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(y)).otherwise(
        x.isNull() & y.isNull())
