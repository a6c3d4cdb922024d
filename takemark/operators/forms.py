"""A contact form: checks of its fields, its steps, and the lookup of an address by zip code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takemark.functions.text import sanitize, zip_digits
from takemark.operators.site import first_errors, limit_decision, walked


@dataclass(frozen=True)
class Field:
    key: str
    kind: str = "text"
    required: bool = False
    most: int | None = None
    rule: str | None = None


#: The fields in their order, the subjects to choose from, and what the rules accept.
FIELDS = (
    Field("company", required=True, most=100),
    Field("department", most=100),
    Field("name", required=True, most=60),
    Field("kana", required=True, most=60, rule="kana"),
    Field("email", "email", True, 120, "email"),
    Field("tel", "tel", True, 20, "tel"),
    Field("zip", most=8, rule="zip"),
    Field("prefecture", most=10),
    Field("city", most=100),
    Field("address", most=150),
    Field("subject", "select", True),
    Field("message", "textarea", True, 2000),
    Field("privacy", "checkbox", True),
)
SUBJECTS = ("製品について", "お見積り・ご注文について", "技術・加工のご相談", "採用について", "取材・広報について", "その他")
RULES = {
    "email": "\\A[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+\\z",
    "tel": "\\A[0-9０-９\\-－\\(\\)\\s]{9,20}\\z",
    "zip": "\\A[0-9]{3}-?[0-9]{4}\\z",
    "kana": "\\A[ぁ-んァ-ヶーー\\s　]+\\z",
}
#: Seconds from showing the form to sending it that no person beats.
FASTEST = 3


def collected(raw: Callable[[str], Column]) -> dict[str, Column]:
    """The values as the form takes them: absent is empty, a checkbox is 1 or empty, line ends stay in text areas only."""
    out = {}
    for f in FIELDS:
        value = F.coalesce(raw(f.key), F.lit(""))
        if f.kind == "checkbox":
            out[f.key] = F.when(value != "", "1").otherwise("")
        elif f.kind == "textarea":
            out[f.key] = F.trim(F.regexp_replace(value, "<[^>]*>", ""))
        else:
            out[f.key] = sanitize(value)
    return out


def contact_errors(values: dict[str, Column], trap: Column, age: Column) -> Column:
    """map<field, code>: ``form`` alone if a field that people don't see is filled, or the form came too fast; else the first failure of each field."""
    rules = {}
    for f in FIELDS:
        v = values[f.key]
        checks = [(v == "", "required")] if f.required else []
        if f.most:
            checks.append((F.length(v) > f.most, "too long"))
        if f.kind == "select":
            checks.append(((v != "") & ~v.isin(*SUBJECTS), "not an option"))
        if f.rule:
            checks.append(((v != "") & ~v.rlike(RULES[f.rule]), f"not a {f.rule}"))
        rules[f.key] = checks
    robot = (F.coalesce(trap, F.lit("")) != "") | F.coalesce(age < FASTEST, F.lit(False))
    return F.when(robot, F.create_map(F.lit("form"), F.lit("rejected"))).otherwise(first_errors(rules))


def next_step(sent: Column, posted: Column, token: Column, action: Column, failed: Column, within: Column, mailed: Column) -> Column:
    """The step that a request shows: sent is the landing after sending; the form is checked unless the visitor goes back; only a send asks for the rate limit and the mail."""
    send = F.when(~within, "input").when(mailed, "redirect").otherwise("confirm")
    checked = F.when(failed, "input").when(action == "confirm", "confirm").when(action == "send", send).otherwise("input")
    return F.when(sent, "complete").when(~posted | ~token | (action == "back"), "input").otherwise(checked)


def form_decision(most: int, seconds: float, age: float, fastest: float = FASTEST):
    """The step that each request of a visitor shows, along the visitor's requests.

    Showing the form issues a token that holds for ``age`` seconds; a request that posts needs a token that holds, or else
    gets the form anew. A send needs the confirmation before it, counts against the visitor's limit, and is known as sent afterwards:
    only then the landing shows completion. All is forgotten when both the token and the limit are over. State: (shown at, confirmed, sent, sends, sends until, ends).
    """
    within = limit_decision(most, seconds)

    def decide(state: tuple, t: float, action: str | None, failed: bool | None, mailed: bool | None) -> tuple[str, tuple]:
        over = not state or t >= state[-1]
        shown, confirmed, sent, n, until, _ = (None, False, False, 0, t, t) if over else state
        step = "input"
        if action == "landing":
            step = "complete" if sent else "input"
            sent = False
        elif action in ("confirm", "send") and shown is not None and fastest <= t - shown < age and not failed:
            if action == "confirm":
                step, confirmed = "confirm", True
            elif confirmed:
                allowed, (n, until) = within((n, until), t)
                step = ("redirect" if mailed else "confirm") if allowed else "input"
                sent = sent or step == "redirect"
        if step == "input":
            shown, confirmed = t, False
        elif step == "redirect":
            shown, confirmed = None, False
        return step, (shown, confirmed, sent, n, until, max(until, t + age))

    return decide


def form_steps(requests: DataFrame, visitor: str, at: str, order: str, action: Column, failed: Column, mailed: Column, most: int = 5, seconds: int = 3600, age: int = 43200) -> DataFrame:
    """requests with step, the one that each shows (see form_decision). Requests without a visitor keep nothing and show the form."""
    return walked(requests, visitor, at, order, "step", "string", form_decision(most, seconds, age), {"action": action, "failed": failed, "mailed": mailed}, F.lit("input"))


def address_of(requests: DataFrame, zip_col: str, own: DataFrame, remote: DataFrame) -> DataFrame:
    """requests with zip, found and address: from own (zip, prefecture, city, town), or else from remote; blank prefectures don't count."""
    asked = requests.withColumn("zip", zip_digits(F.col(zip_col)))
    for name, table in (("_own", own), ("_remote", remote)):
        known = table.where(F.coalesce("prefecture", F.lit("")) != "").groupBy("zip").agg(F.min(F.struct("prefecture", "city", "town", F.concat("prefecture", "city", "town").alias("full"))).alias(name))
        asked = asked.join(known, "zip", "left")
    valid = F.length("zip") == 7
    address = F.when(valid, F.coalesce("_own", "_remote"))
    return asked.withColumn("address", address).withColumn("found", F.col("address").isNotNull()).drop("_own", "_remote")


#: The shape of a provider's answer, and what is said where nothing is found.
PROVIDED = "results array<struct<address1:string,address2:string,address3:string>>"
NOT_FOUND = "該当する住所が見つかりませんでした。"


def provided_address(code: Column, status: Column, body: Column) -> Column:
    """struct<state, address>: what a provider's answer says about a zip code.

    state: not asked (no valid code), failed (no answer, or another status than 200), malformed (no JSON object), nothing (no first
    result, or one without a prefecture) or found; the address is null but for found. Only the first result counts.
    """
    first = F.get(F.from_json(body, PROVIDED, {"mode": "PERMISSIVE"})["results"], F.lit(0))
    part = lambda k: F.coalesce(first[f"address{k}"], F.lit(""))
    readable = F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{")
    state = (
        F.when(F.coalesce(F.length(code) != 7, F.lit(True)), "not asked").when(body.isNull() | F.coalesce(status != 200, F.lit(True)), "failed")
        .when(~readable, "malformed").when(part(1) == "", "nothing").otherwise("found")
    )
    address = F.struct(part(1).alias("prefecture"), part(2).alias("city"), part(3).alias("town"), F.concat(part(1), part(2), part(3)).alias("full"))
    return F.struct(state.alias("state"), F.when(state == "found", address).alias("address"))


def zip_response(code: Column, address: Column) -> Column:
    """The JSON that a lookup answers with."""
    found = F.to_json(F.struct(F.lit(True).alias("found"), code.alias("zipcode"), address.alias("address")))
    return F.when(address.isNotNull(), found).otherwise(F.to_json(F.struct(F.lit(False).alias("found"), F.lit(NOT_FOUND).alias("message"))))


def cache_life(state: Column) -> Column:
    """Seconds that an answer is kept: 30 days where something was found, an hour for all others, so that a provider's faults pass."""
    return F.when(state == "found", 30 * 86400.0).otherwise(3600.0)


def body_class(kind: Column, slug: Column) -> Column:
    """The class of a page by its kind; null for kinds without one."""
    return F.when(kind == "front", "p-home").when(kind == "page", F.concat(F.lit("p-"), slug)).when(kind == "news", "p-news-detail").when(kind.isin("archive", "category"), "p-news")
