"""The two messages that a sent contact form makes, as rows; delivery is not part of this."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takemark.functions.text import one_line
from takemark.operators.forms import FIELDS

#: The labels of the fields, and the sentences and marks of the messages.
LABELS = {
    "company": "会社名", "department": "部署名", "name": "お名前", "kana": "フリガナ", "email": "メールアドレス", "tel": "電話番号", "zip": "郵便番号",
    "prefecture": "都道府県", "city": "市区町村", "address": "番地・建物名", "subject": "お問い合わせ種別", "message": "お問い合わせ内容", "privacy": "個人情報の取り扱い",
}
BLANK, UNKNOWN = "（未入力）", "不明"
RULE = "-" * 48
OPENING = "ウェブサイトのお問い合わせフォームから送信がありました。"
THANKS = ("このたびはお問い合わせをいただき、誠にありがとうございます。", "以下の内容で受け付けいたしました。担当者より改めてご連絡いたします。")
CLOSING = "※このメールは自動送信です。ご返信いただいてもお答えできません。"
PLAIN = "Content-Type: text/plain; charset=UTF-8"
STAMP = "yyyy年M月d日 HH:mm"


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def messages(requests: DataFrame, keys: list[str], values: dict[str, Column], at: Column, address: Column, site: str, to: str, accepted: Column) -> DataFrame:
    """(keys, kind, recipient, subject, headers, body): a notification for every request, and a reply where that was accepted.

    values: as ``forms.collected`` gives them. Subjects and headers are single lines whatever the fields hold. Blank
    fields are marked, the consent isn't listed, an address that isn't known is named so; a null ``accepted`` is no.
    """
    listed = [_say(f"{LABELS[f.key]}: ", F.when(values[f.key] == "", BLANK).otherwise(values[f.key])) for f in FIELDS if f.key != "privacy"]
    sender = F.coalesce(F.when(F.trim(address) != "", F.trim(address)), F.lit(UNKNOWN))
    notice = F.struct(
        F.lit("notice").alias("kind"), F.lit(to).alias("recipient"), one_line(_say(f"[{site}] お問い合わせ（", values["subject"], "）")).alias("subject"),
        F.array(F.lit(PLAIN), _say("Reply-To: ", one_line(values["name"]), " <", one_line(values["email"]), ">")).alias("headers"),
        _lines(OPENING, "", RULE, *listed, RULE, "", _say("送信日時: ", F.coalesce(F.date_format(at, STAMP), F.lit(""))), _say("送信元 IP: ", sender)).alias("body"),
    )
    reply = F.struct(
        F.lit("reply").alias("kind"), values["email"].alias("recipient"), F.lit(f"【{site}】お問い合わせを受け付けました").alias("subject"), F.array(F.lit(PLAIN)).alias("headers"),
        _lines(values["company"], _say(values["name"], " 様"), "", *THANKS, "", RULE, _say(f"{LABELS['subject']}: ", values["subject"]), "", values["message"], RULE, "", CLOSING, "", site).alias("body"),
    )
    both = F.when(F.coalesce(accepted, F.lit(False)), F.array(notice, reply)).otherwise(F.array(notice))
    return requests.select(*keys, F.explode(both).alias("m")).select(*keys, "m.*")
