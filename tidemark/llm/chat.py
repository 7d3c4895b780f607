"""Chat formatting with a grammar that is read back.

    conversation := turn*
    turn         := "<s>" mark " " text " " endmark "</s>\\n"        ("<s e=K>": the text was escaped K times)
    mark         := "[INST]" (user) | "[OUT]" (assistant) | "<<SYS>>" (system) | "[ROLE name]" (any other, percent-encoded)

Every rendered turn is parsed again and compared with its source; while they differ, the text is escaped once more. Escaping puts
a backslash behind the first character of each control string, with the backslashes there already, and unescaping takes it
away, so any text comes back. A turn's rendered text is a row and a conversation is its rows in order, so that no task has to
hold one. The loss mask covers the assistant's texts.

Null text or role: empty. Turns in order of turn (nulls first), then role, then text; repeated rows are repeated turns. A null
conv_id is a conversation; the others have to be integers. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "[/OUT]"), "system": ("<<SYS>>", "<</SYS>>")}
_CONTROL = r"/?s(?: e=\d+)?>|</?SYS>>|/?INST\]|/?OUT\]|/?ROLE"
_ANY = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_PLAIN = re.compile(rf"[<\[](?:{_CONTROL})")
_OPEN = re.compile(r"<s(?: e=(\d+))?>(?:(\[INST\]|\[OUT\]|<<SYS>>)|\[ROLE ([^\]\s]*)\]) ")
_ROLES = {a: (role, b) for role, (a, b) in _MARKS.items()}
RENDERED = "rendered string, body_start int, body_end int"


def escape(text: str) -> str:
    return _ANY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class NotATurn(ValueError):
    pass


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """role, text, where its body begins and ends, where the turn ends."""
    head = _OPEN.match(text, at)
    if not head:
        raise NotATurn(at)
    role, close = _ROLES[head[2]] if head[2] else (unquote(head[3]), "[/ROLE]")
    first = _PLAIN.search(text, head.end())  # no control string stands in a body
    if not first or not text.startswith(f" {close}</s>\n", first.start() - 1) or first.start() - 1 < head.end():
        raise NotATurn(at)
    body, end = text[head.end() : first.start() - 1], first.start() + len(close) + 5
    for _ in range(int(head[1] or 0)):
        body = unescape(body)
    return role, body, head.end(), first.start() - 1, end


def parse(text: str) -> list[tuple[str, str]]:
    at, turns = 0, []
    while at < len(text):
        role, body, _, _, at = parse_turn(text, at)
        turns.append((role, body))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn and where its body begins and ends."""
    mark, close = _MARKS.get(role) or (f"[ROLE {quote(role, safe='')}]", "[/ROLE]")
    body, times = text, 0
    while True:
        out = f"<s{f' e={times}' if times else ''}>{mark} {body} {close}</s>\n"
        try:
            back = parse_turn(out)
            if back[:2] == (role, text) and back[4] == len(out):
                return out, back[2], back[3]
        except NotATurn:
            pass
        body, times = escape(body), times + 1


def rendered(role: Column, text: Column) -> Column:
    @F.pandas_udf(RENDERED)
    def turns(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render(r or "", t or "") for r, t in zip(roles.tolist(), texts.tolist(), strict=True)], columns=["rendered", "body_start", "body_end"])

    return turns(role, text)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, source text, rendered, mask_start, mask_end (code points in `rendered` that bear loss; null: none)."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("r", rendered(F.col("role"), F.col("text")))
    loss = [F.when(F.col("role") == "assistant", F.col(f"r.body_{x}")).alias(f"mask_{x}") for x in ("start", "end")]
    return rows.select("conv_id", "turn", "role", "text", "r.rendered", *loss)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of their conversation: digests run on from batch to batch, no conversation is held."""
    now, state, out = object(), None, []

    def row():
        turns, all_, chars, loss, length = state
        return (None if now is None else int(now), turns, all_.hexdigest(), chars, loss.hexdigest(), length)

    for batch in batches:
        for conv, text, a, b in zip(batch["conv"].tolist(), batch["rendered"].tolist(), batch["mask_start"].tolist(), batch["mask_end"].tolist(), strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            if a == a and a is not None:
                times, masked = int(_OPEN.match(text)[1] or 0), text[int(a) : int(b)]
                for _ in range(times):
                    masked = unescape(masked)
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])
            out = []
    if state is not None:
        yield pd.DataFrame([row()], columns=[c.split()[0] for c in READ.split(", ")])


def read_back(conversations: DataFrame) -> DataFrame:
    """From the rows of `formatted`: digests of what the parser and the loss mask give for each conversation."""
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("conv_id").alias("k"), "turn", "role", "text", "rendered", "mask_start", "mask_end")
    rows = rows.repartition("k").sortWithinPartitions("k", "turn", "role", "text")
    return rows.select("conv", "rendered", "mask_start", "mask_end").mapInPandas(_read, READ)
