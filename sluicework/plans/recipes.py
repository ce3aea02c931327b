"""Ready-made templates for common exports. Each takes the column names of its input."""

from __future__ import annotations

from .. import functions as fn
from ..operators.cleaning import blank_nulls, boolean_word, number_value
from ..operators.lookup import Lookup
from ..operators.rules import Rule
from .template import Template

f = fn.field

LEDGER = [
    "date", "symbol", "quantity", "activityType", "unitPrice", "currency", "fee", "amount", "account", "fxRate",
    "subtype", "instrumentType", "comment",
]


def plain(name: str, variables: dict, rules=None, **more) -> Template:
    """Variables written under their own names."""
    return Template(name, variables, {n: n for n in variables}, rules if rules is not None else [Rule()], **more)


def null_spellings(columns: list[str], keep: list[str] = ()) -> Template:
    return plain("null_spellings", {**{c: f(c) for c in keep}, **{c: blank_nulls(c) for c in columns}})


def boolean_spellings(columns: list[str], keep: list[str] = ()) -> Template:
    return plain("boolean_spellings", {**{c: f(c) for c in keep}, **{c: boolean_word(c) for c in columns}})


def styled_number(column: str, style: str, out: str = "amount", keep: list[str] = ()) -> Template:
    return plain("styled_number", {**{c: f(c) for c in keep}, out: number_value(column, style)})


def number_and_unit(column: str, keep: list[str] = ()) -> Template:
    amount = fn.if_(fn.isempty(f(column)), "", fn.split_part(f(column), " ", 1) * 1)
    return plain("number_and_unit", {**{c: f(c) for c in keep}, "amount": amount, "unit": fn.split_part(f(column), " ", 2)})


def price_and_currency(column: str, keep: list[str] = ()) -> Template:
    amount = fn.if_(fn.isempty(f(column)), "", fn.price_value(f(column)) * 1)
    return plain("price_and_currency", {**{c: f(c) for c in keep}, "price": amount, "currency": fn.price_currency(f(column))})


def zone_report(time: str, offset_time: str, zone: str, target: str, keep: list[str] = ()) -> Template:
    return plain("zone_report", {
        **{c: f(c) for c in keep},
        "utc": fn.to_utc(f(offset_time), "YYYY-MM-DD[T]hh:mm:ssZZ"),
        "offset": fn.tz_offset(f(time), f(zone)),
        "dst": fn.is_dst(f(time), f(zone)),
        "there": fn.tz_convert(f(time), f(zone), target),
    })


def memo_tokens(memo: str, tags: str, keep: list[str] = ()) -> Template:
    """Invoice and order references out of free text."""
    m = f(memo)
    return plain("memo_tokens", {
        **{c: f(c) for c in keep},
        "invoice": fn.regex_extract(m, "INV-([0-9]{4}-[0-9]{4})"),
        "order_ref": fn.regex_extract(m, "#([0-9]+)"),
        "has_ref": fn.regex_match(m, "INV-[0-9]{4}|#[0-9]+"),
        "priority": fn.split_part(f(tags), "|", 1),
    })


def memo_tokens_cheap(memo: str, tags: str, keep: list[str] = ()) -> Template:
    """The same references by literal splitting, for memos with fixed markers."""
    m = f(memo)
    invoice = fn.left(fn.split_part(m, "INV-", 2), 9)
    order = fn.split_part(fn.split_part(m, "#", 2), " ", 1)
    return plain("memo_tokens_cheap", {
        **{c: f(c) for c in keep}, "invoice": invoice, "order_ref": order,
        "has_ref": fn.contains(m, "INV-") | fn.contains(m, "#"), "priority": fn.split_part(f(tags), "|", 1),
    })


def wide_to_long(keep: dict, columns: dict[str, str], label: str, value: str, extra: dict[str, dict] | None = None) -> Template:
    """One row per source column, each with a literal label and optional extra literals."""
    extra = extra or {}
    rows = [
        {label: fn.const(text), value: f(c), **{k: fn.const(v[c]) for k, v in extra.items()}} for c, text in columns.items()
    ]
    names = [*keep, label, *extra, value]
    return Template("wide_to_long", keep, {n: n for n in names}, [Rule(True, rows)])


def parent_names(key: str, name: str, kind: str, parent: str) -> Template:
    """Name each child's parent from the same file."""
    return Template(
        "parent_names",
        {
            "stop_id": f(key), "name": f(name), "kind": fn.if_(f(kind) == "1", "station", "platform"), "parent_id": f(parent),
            "parent_station_name": fn.if_(fn.isempty(f(parent)), "", fn.lookup(f(parent), "station_name")),
        },
        {n: n for n in ("stop_id", "name", "kind", "parent_id", "parent_station_name")},
        lookups={"stations": Lookup(f(key), {"station_name": f(name)}, f(kind) == "1")},
    )


def segment_roster(segment: str = "PID") -> Template:
    """Patients out of a headerless segment feed: caret and ampersand components by position."""
    born = fn.fields(8)
    return plain("segment_roster", {
        "mrn": fn.split_part(fn.fields(4), "^", 1),
        "family": fn.split_part(fn.split_part(fn.fields(6), "^", 1), "&", 1),
        "given": fn.split_part(fn.fields(6), "^", 2),
        "dob": fn.if_(fn.isempty(born), "", fn.concat(fn.left(born, 4), "-", fn.substr(born, 5, 2), "-", fn.substr(born, 7, 2))),
        "sex": fn.fields(9),
    }, [Rule(fn.fields(1) == segment)])


def _sixtieths(c) -> "fn.Val":
    whole, minutes, seconds = (fn.split_part(c, ":", i) for i in (1, 2, 3))
    return fn.abs_(whole) + minutes / 60 + seconds / 3600


def sexagesimal(hours: str, degrees: str, keep: list[str] = ()) -> Template:
    """Hours and degrees with minutes and seconds to decimal degrees."""
    side = fn.if_(fn.starts_with(fn.trim(f(degrees)), "-"), -1, 1)
    return plain("sexagesimal", {
        **{c: f(c) for c in keep},
        "ra_deg": fn.if_(fn.isempty(f(hours)), "", _sixtieths(f(hours)) * 15),
        "dec_deg": fn.if_(fn.isempty(f(degrees)), "", side * _sixtieths(f(degrees))),
    })


def tenths(columns: dict[str, str], high: str, low: str, keep: list[str] = ()) -> Template:
    """Readings stored in tenths, with a consistency flag for a pair of them."""
    made = {out: fn.if_(fn.isempty(f(c)), "", fn.trim(f(c)) / 10) for c, out in columns.items()}
    gap = fn.isempty(f(high)) | fn.isempty(f(low))
    flag = fn.if_(gap, "partial", fn.if_(fn.trim(f(high)) < fn.trim(f(low)), f"{high}_below_{low}", "ok"))
    return plain("tenths", {**{c: f(c) for c in keep}, **made, "consistency": flag})


def trips(pickup: str, dropoff: str, passengers: str, flag: str, payment: str, fare: str, labels: dict[str, str], keep=()) -> Template:
    stamp = "MM/DD/YYYY ii:mm:ss A"
    out = "YYYY-MM-DD[T]hh:mm:ss[Z]"
    empty_car = ~fn.isempty(f(passengers)) & (f(passengers) == 0)
    return plain("trips", {
        **{c: f(c) for c in keep},
        "pickup_at": fn.date_convert(f(pickup), stamp, out),
        "dropoff_at": fn.date_convert(f(dropoff), stamp, out),
        "stored": fn.if_(f(flag) == "Y", "true", "false"),
        "payment": fn.remap(f(payment), labels),
        "quality": fn.if_(empty_car, "no_passengers", fn.if_(f(fare) < 0, "refund", "ok")),
    })


def ledger(name: str, base: dict, actions: list[Rule], **more) -> Template:
    """A portfolio ledger: the thirteen columns, blanks where the source has nothing to say."""
    variables = {c: fn.const("") for c in LEDGER if c != "activityType"}
    variables.update(base)
    return Template(name, variables, {c: c for c in LEDGER}, actions, **more)


def act(kind: str, when, **overrides) -> Rule:
    return Rule(when, [{"activityType": fn.const(kind), **overrides}])


def paired_trades(symbols: dict[str, str], **more) -> Template:
    """Statement lines where a trade is a payment line and a fill line under one order id."""
    cash = f("Type") == "deposit"
    paid, coin = fn.lookup(f("Order ID"), "paid"), fn.lookup(f("Order ID"), "coin")
    return ledger("paired_trades", {
        "date": fn.date_convert(f("Date"), "YYYY-MM-DD[T]hh:mm:ss[*]", "YYYY-MM-DD hh:mm:ss"),
        "symbol": fn.if_(cash, fn.concat("$CASH-", f("Currency")), fn.remap(f("Currency"), symbols)),
        "quantity": fn.if_(cash, 1, f("Amount")),
        "unitPrice": fn.if_(cash, f("Amount"), paid / f("Amount")),
        "currency": fn.if_(cash, f("Currency"), coin),
        "amount": fn.if_(cash, f("Amount"), paid),
        "comment": f("TX"),
    }, [
        act("DEPOSIT", cash), act("BUY", f("Type") == "trade fill"),
        Rule(fn.in_(f("Type"), "trade payment", "withdrawal", "withdrawal_block", "withdrawal_unblock"), []),
    ], lookups={"payments": Lookup(f("Order ID"), {"paid": fn.abs_(f("Amount")), "coin": f("Currency")}, f("Type") == "trade payment")}, **more)


def month_name_orders(symbols: dict[str, str], **more) -> Template:
    """Order history with ``D MMM YYYY`` stamps and currency-marked prices."""
    other = f("Type") == "Other"
    stamp = "D MMM YYYY, hh:mm:ss"
    fees = fn.price_value(f("Fees"))
    return ledger("month_name_orders", {
        "date": fn.date_convert(f("Date"), stamp, "YYYY-MM-DD hh:mm:ss"),
        "symbol": fn.if_(other, fn.concat("$CASH-", fn.price_currency(f("Value"))), fn.remap(f("Symbol"), symbols)),
        "quantity": fn.if_(other, 1, f("Quantity")),
        "unitPrice": fn.price_value(fn.if_(other, f("Value"), f("Price"))),
        "currency": fn.price_currency(f("Value")),
        "fee": fn.if_(fees > 0, fees, ""),
        "amount": fn.price_value(f("Value")),
        "comment": fn.date_convert(f("Date"), stamp, "YYYYMMDDhhmmss"),
    }, [
        act("BUY", fn.in_(f("Type"), "Buy", "Buy - X")), act("SELL", f("Type") == "Sell"), act("DEPOSIT", other),
        Rule(fn.in_(f("Type"), "Staking reward", "Stake", "Unstake", "Learn reward"), []),
    ], date_range="date", **more)


def many_actions(symbols: dict[str, str], **more) -> Template:
    """A statement with trades, cash moves, dividends and conversions; one conversion makes three rows."""
    held = ~fn.isempty(f("Ticker"))
    costs = fn.abs_(f("Conversion fee")) + fn.abs_(f("Stamp duty"))
    net = fn.abs_(f("Total")) - costs
    bare = {"quantity": fn.const(""), "unitPrice": fn.const("")}

    def money(kind, currency, amount):
        return {"activityType": fn.const(kind), "symbol": fn.concat("$CASH-", f(currency)), "currency": f(currency),
                "fee": fn.const(""), "amount": fn.abs_(f(amount)), **bare}

    buys = fn.in_(f("Action"), "Market buy", "Limit buy")
    return ledger("many_actions", {
        "date": f("Time"),
        "symbol": fn.if_(held, fn.remap(f("Ticker"), symbols), fn.concat("$CASH-", f("Currency"))),
        "quantity": fn.if_(held, f("Shares"), 1),
        "unitPrice": fn.if_(held, net / f("Shares"), fn.abs_(f("Total"))),
        "currency": f("Currency"),
        "fee": fn.if_(costs > 0, costs, ""),
        "amount": fn.if_(held, net, fn.abs_(f("Total"))),
        "comment": fn.concat(f("ID"), "_", f("Time")),
    }, [
        act("TRANSFER_IN", buys & (f("Total") == 0)), act("BUY", buys), act("SELL", f("Action") == "Market sell"),
        act("DEPOSIT", f("Action") == "Deposit", **bare), act("WITHDRAWAL", f("Action") == "Withdrawal", **bare),
        act("DIVIDEND", fn.starts_with(f("Action"), "Dividend (")),
        Rule(f("Action") == "Currency conversion", [
            money("FEE", "Fee currency", "Conversion fee"), money("WITHDRAWAL", "From currency", "From"), money("DEPOSIT", "To currency", "To"),
        ]),
        Rule(f("Action") == "Adjustment", [{"activityType": fn.if_(f("Total") > 0, "DEPOSIT", "WITHDRAWAL"), **bare}]),
    ], **more)


def cash_sheet(symbol: str, types: dict[str, str], buy: str, symbols: dict[str, str], currency: str, **more) -> Template:
    """A cash-operations sheet; bought quantities stand in the comment (``OPEN BUY 3/5 @ 12.5``)."""
    size = fn.split_part(fn.split_part(f("Comment"), " ", 3), "/", 1)
    return ledger("cash_sheet", {
        "date": f("Time"),
        "symbol": fn.if_(~fn.isempty(f(symbol)), fn.remap(f(symbol), symbols), f"$CASH-{currency}"),
        "quantity": fn.const("1"), "unitPrice": fn.abs_(f("Amount")), "currency": fn.const(currency), "amount": fn.abs_(f("Amount")),
        "comment": fn.concat(f("ID"), "_", f("Time"), "_", f("Comment")),
    }, [
        *[act(kind, f("Type") == t) for t, kind in types.items()],
        act("BUY", f("Type") == buy, symbol=fn.remap(f(symbol), symbols), quantity=size, unitPrice=fn.abs_(f("Amount")) / size),
        Rule(fn.isempty(f("Type")), []),
    ], **more)


def closed_sheet(symbol: str, closed: str, price: str, value: str, symbols: dict[str, str], currency: str, **more) -> Template:
    """A closed-positions sheet: every position with a close time is a sale."""
    return ledger("closed_sheet", {
        "date": f(closed), "symbol": fn.remap(f(symbol), symbols), "quantity": f("Volume"), "unitPrice": f(price),
        "currency": fn.const(currency), "amount": f(value), "comment": f("Position"),
    }, [act("SELL", ~fn.isempty(f(symbol)) & ~fn.isempty(f(closed)))], **more)
