"""Exported conversations as JSON, HTML or text: one row per message, whatever the export looks like.

JSON: of all lists at any depth up to DEPTH the one that looks most like messages. HTML: JSON held in a script, else the elements
of the first selector that finds two or more. Text: lines that begin with a speaker, else blocks parted by empty lines. An export
in which nothing of this is found has no rows. Exports are parsed in Arrow batches, one text at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed names, as exports have them.
ROLES = {
    **dict.fromkeys(("assistant", "ai", "bot", "character", "char"), "character"),
    **dict.fromkeys(("user", "human", "you", "me"), "user"),
    **dict.fromkeys(("system", "ooc", "directive"), "system"),
}
USER_NAMES = ("user", "you", "me", "human")
CONTENT = ("content", "message", "text", "mes", "body", "value", "response")
INNER = ("text", "content")
LISTS = ("messages", "history", "conversation", "chat", "items", "turns")
SPEAKER = ("name", "author", "speaker", "sender_name", "senderName")
ROLE = ("role", "type", "sender", "from")
USER_FLAGS = ("is_user", "isUser")
AGAIN_FLAGS = ("is_regeneration", "isRegeneration", "regenerated", "is_alternative", "isAlternative")
AGAIN_NUMBERS = ("swipe_id", "swipeId", "variant_index", "variantIndex")
TIMES = ("createdAt", "created_at", "timestamp", "time")
DEPTH = 7
#: Exports that a worker parses at once, whatever the size of an Arrow batch.
ROWS = 64
#: Fixed words with which a message that is no part of the play begins, and the longest name of a speaker.
ASIDES = ("ooc", "system", "creator note", "directive")
NAME_LENGTH = 60

_MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ooc", T.BooleanType()), T.StructField("regen", T.BooleanType()), T.StructField("at", T.StringType())]
)


def _first(item: dict, names: tuple[str, ...]) -> object:
    return next((item[n] for n in names if item.get(n) is not None), None)


def _said(value: object) -> str:
    """The text of a message's content: text itself, parts of a list as lines, or what an object holds as text."""
    if isinstance(value, list):
        value = "\n".join(str(p if isinstance(p, str) else (_first(p, INNER) if isinstance(p, dict) else None) or "") for p in value)
    elif isinstance(value, dict):
        value = _first(value, INNER)
    return "" if value is None or value is False or isinstance(value, list | dict) else str(value).strip()


def content(item: object) -> str:
    return _said(_first(item, CONTENT)) if isinstance(item, dict) else ""


def role_of(raw: object, speaker: str, bot: str) -> str:
    """By the role's name, else by the speaker: the bot by its name, the user by the usual ones."""
    named = ROLES.get(str(raw or "").lower())
    own = speaker.strip().lower()
    return named or ("character" if bot.strip() and own == bot.strip().lower() else "user" if own in USER_NAMES else "unknown")


def _lists(value: object, depth: int = 0) -> Iterator[tuple[int, list]]:
    """All lists with two messages or more and their scores: three a message, a fourth if all are messages or the key is a usual one."""
    if depth > DEPTH:
        return
    if isinstance(value, list):
        n = sum(map(bool, map(content, value)))
        if n >= 2:
            yield 3 * n + n * (n == len(value)), value
        for inner in value:
            yield from _lists(inner, depth + 1)
    elif isinstance(value, dict):
        for key, inner in value.items():
            if key in LISTS and isinstance(inner, list) and (n := sum(map(bool, map(content, inner)))) >= 2:
                yield 4 * n, inner
            yield from _lists(inner, depth + 1)


def best_list(value: object) -> list:
    """The list with the highest score, the first of equal ones; empty if there is none."""
    return max(_lists(value), key=lambda x: x[0], default=(0, []))[1]


def from_items(items: list, bot: str) -> list[dict]:
    out: list[dict] = []
    for item in items:
        text = content(item)
        if not text:
            continue
        speaker = str(_first(item, SPEAKER) or "").strip()
        flag = next((item[f] for f in USER_FLAGS if isinstance(item.get(f), bool)), None)
        role = role_of(_first(item, ROLE), speaker, bot) if flag is None else "user" if flag else "character"
        again = any(item.get(f) for f in AGAIN_FLAGS) or any(str(item.get(f) or 0).isdigit() and int(item.get(f) or 0) > 0 for f in AGAIN_NUMBERS)
        repeat = bool(out) and (out[-1]["role"], out[-1]["text"]) == (role, text)
        out.append(_message(role, speaker, text, again or repeat, str(next((item[t] for t in TIMES if item.get(t)), ""))))
    return out


def is_aside(text: str) -> bool:
    """Whether a text begins with one of ASIDES as a whole word, in brackets or not."""
    start = re.sub(r"^\s*[\[(]?\s*", "", text[:200]).lower()
    return any(start.startswith(w) and not re.match(r"\w", start[len(w) :]) for w in ASIDES)


def _message(role: str, speaker: str, text: str, regen: bool = False, at: str = "") -> dict:
    return {"role": role, "speaker": speaker, "text": text, "ooc": role == "system" or is_aside(text), "regen": regen, "at": at}


def from_json(text: str, bot: str) -> list[dict]:
    return from_items(best_list(json.loads(text)), bot)


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.classes, self.inner = tag, attrs, set((attrs.get("class") or "").split()), []

    def walk(self) -> Iterator[_Node]:
        """The nodes below, in the order of the document."""
        stack = [n for n in reversed(self.inner) if isinstance(n, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [n for n in reversed(node.inner) if isinstance(n, _Node)]

    def text(self) -> str:
        parts, stack = [], list(reversed(self.inner))
        while stack:
            x = stack.pop()
            parts.append(x) if isinstance(x, str) else stack.extend(reversed(x.inner))
        return "".join(parts)


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


def _has(attribute: str = "", name: str = "") -> Callable[[_Node], bool]:
    return lambda n: (not attribute or attribute in n.attrs) and (not name or name in n.classes)


#: Fixed selectors, in order: elements that are messages, and those in them that hold what is said and by whom.
MESSAGE_NODES = (_has("data-message-id"), _has("data-message-role"), _has("data-role", "message"), _has(name="chat-message"), _has(name="message"), _has(name="mes"))
CONTENT_NODES = (_has("data-message-content"), *(_has(name=n) for n in ("message-content", "mes_text", "markdown", "prose", "content")))
SPEAKER_NODES = (_has("data-speaker"), *(_has(name=n) for n in ("message-name", "mes_name", "speaker", "name")))
ROLE_ATTRIBUTES = ("data-message-role", "data-role", "data-author-role")


def from_html(page: str, bot: str) -> list[dict]:
    nodes = list(_Tree(page).root.walk())
    for script in nodes:
        if script.tag == "script" and (script.attrs.get("type") == "application/json" or script.attrs.get("id") == "__NEXT_DATA__"):
            try:
                items = best_list(json.loads(script.text()))
            except ValueError:
                continue
            if items:
                return from_items(items, bot)
    found = next((own for is_message in MESSAGE_NODES if len(own := [n for n in nodes if is_message(n)]) >= 2), [])
    out: dict[tuple[str, str], dict] = {}
    for node in found:
        below = list(node.walk())
        part = lambda selectors, below=below: next((n for n in below if any(s(n) for s in selectors)), None)
        text = (part(CONTENT_NODES) or node).text().strip()
        who = part(SPEAKER_NODES)
        speaker = (who.text() if who else "").strip() or node.attrs.get("data-speaker") or node.attrs.get("data-name") or ""
        role = role_of(next((node.attrs[a] for a in ROLE_ATTRIBUTES if node.attrs.get(a)), ""), speaker.strip(), bot)
        if text:
            again = bool(re.search("regen|swipe|alternative", node.attrs.get("class", ""), re.I))
            out.setdefault((role, text), _message(role, speaker.strip(), text, again, node.attrs.get("datetime", "")))
    return list(out.values()) if len(out) >= 2 else []


def from_text(text: str, bot: str) -> list[dict]:
    turns: list[tuple[str, list[str]]] = []
    for line in text.replace("\r", "").split("\n"):
        before, colon, behind = line.partition(":")
        who = before.strip().strip("*").strip()
        if colon and who and len(who) <= NAME_LENGTH:
            turns.append((who, [behind]))
        elif turns:
            turns[-1][1].append(line)
    said = [(who, body) for who, lines in turns if (body := "\n".join(lines).strip())]
    if len(said) >= 2:
        return [_message(role_of("", who, bot), who, body) for who, body in said]
    blocks = [b for x in re.split(r"\n\s*\n+", text) if (b := x.strip())]
    return [_message("unknown", "", b) for b in blocks] if len(blocks) >= 2 else []


FORMS = {"json": from_json, "html": from_html, "text": from_text}


def _parsed(form: str | None, text: str | None, bot: str | None) -> list[dict]:
    try:
        return FORMS[form](text, bot or "") if form in FORMS and text else []
    except (ValueError, RecursionError):
        return []


def form_of(text: Column) -> Column:
    """json or html by what the text begins with, else text."""
    start = F.ltrim(text)
    return F.when(start.rlike(r"^[\[{]"), "json").when(F.lower(start).startswith("<"), "html").otherwise("text")


def messages(exports: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The kept columns, pos and role, speaker, text, ooc, regen, at of each message of exports (form, text, bot)."""
    own = exports.select(*keep, "form", "text", "bot")
    schema = T.StructType([*exports.select(*keep).schema, T.StructField("pos", T.IntegerType()), *_MESSAGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            told = [_parsed(*x) for x in zip(*(part.column(len(keep) + i).to_pylist() for i in range(3)), strict=True)]
            at = pa.array([i for i, m in enumerate(told) for _ in m], pa.int64())
            kept = [part.column(i).take(at) for i in range(len(keep))]
            pos = pa.array([i for m in told for i in range(len(m))], pa.int32())
            said = [pa.array([x[f.name] for m in told for x in m], pa.bool_() if f.name in ("ooc", "regen") else pa.string()) for f in _MESSAGE]
            yield pa.RecordBatch.from_arrays([*kept, pos, *said], names=schema.names)

    return own.mapInArrow(run, schema)
