"""Chat formatting: typed content parts become one marked text a conversation, with a loss mask, by column expressions alone.

A message has a role and parts: text, image, audio or document. A visitor flattens each part: text is escaped, anything else
becomes a placeholder, and its reference and the number of tokens that the placeholder stands for are recorded in order. A
message is then `<turn>role<body>parts</turn>`. Inside roles and texts a backslash is doubled and a backslash breaks each
control string behind its first character, so no text can forge a mark and read() takes the marks off again without loss.
Each turn has its place in the mask as (skip, take): so many characters (code points) from the turn's mark on aren't
learned, so many are. Only turns of trained roles have any.

parts_of() makes parts of plain texts: Markdown pictures, recordings and papers (`![name](place)`) become attachments that
keep their source, so that the text comes back whole.

A null text, role or list of parts is empty; a part of another kind is text. Turns stand by number, those without one first,
equal ones by role and content; repeated rows are kept. A null conversation id is one conversation. An empty table gives no
rows. Columns besides conv_id, turn, role and parts are not used, so their names can't clash. Texts are read whole. A
conversation's marked text is one value, so a conversation is as long as a Spark string may be (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, uri: string, source: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENTS = "array<struct<kind: string, uri: string, source: string, tokens: bigint>>"
#: A Markdown attachment, and what its place ends in if it is no picture.
ATTACHED = r"!\[[^\]\n]*\]\(([^)\s]+)\)"
SOUND, PAPER = r"(?i)\.(wav|mp3|flac|ogg|m4a)$", r"(?i)\.(pdf|docx?|odt|html?|txt|md|csv)$"


@dataclass(frozen=True)
class Template:
    """The marks; which roles are learned; the side of an image's tile in pixels, tokens of a second and of a page."""

    turn: str = "<turn>"
    body: str = "<body>"
    end: str = "</turn>"
    image: str = "<image>"
    audio: str = "<audio>"
    document: str = "<document>"
    trained: tuple[str, ...] = ("assistant",)
    tile: int = 28
    second: float = 25.0
    page: int = 768

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < len(marks) or any(len(m) < 2 or m[0] != "<" or "<" in m[1:] or "\\" in m for m in marks):
            raise ValueError("marks differ, begin with <, and hold no other < and no backslash")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no mark begins with another")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, self.image, self.audio, self.document)

    @property
    def placeholders(self) -> str:
        return "|".join(map(re.escape, (self.image, self.audio, self.document)))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\|<(?=" + "|".join(re.escape(m[1:]) for m in self.marks) + ")", r"$0\\")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class Visitor:
    """What a part of each kind leaves in the text, and the tokens that it stands for."""

    def __init__(self, template: Template):
        self.template = template

    def text(self, part: Column) -> tuple[Column, Column]:
        return self.template.escaped(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        tiles = lambda side: F.ceil(part[side] / F.lit(self.template.tile))
        return F.lit(self.template.image), tiles("width") * tiles("height")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.audio), F.ceil(part["seconds"] * F.lit(self.template.second))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.document), part["pages"] * F.lit(self.template.page)

    def visit(self, part: Column) -> Column:
        """(piece, attachment): the attachment is null for text; it stands for a token at least."""
        piece, _ = self.text(part)
        tokens = F.lit(1)
        for kind in ("image", "audio", "document"):
            mark, n = getattr(self, kind)(part)
            piece, tokens = F.when(part["kind"] == kind, mark).otherwise(piece), F.when(part["kind"] == kind, n).otherwise(tokens)
        attachment = F.struct(part["kind"].alias("kind"), part["uri"].alias("uri"), part["source"].alias("source"), F.greatest(F.lit(1), tokens).cast("long").alias("tokens"))
        return F.struct(piece.alias("piece"), F.when(part["kind"].isin("image", "audio", "document"), attachment).alias("attachment"))


def _part(kind: Column, text: Column, uri: Column, source: Column) -> Column:
    none = {n: F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.struct(kind.alias("kind"), text.cast("string").alias("text"), uri.cast("string").alias("uri"), source.cast("string").alias("source"), *none.values())


def parts_of(text: Column) -> Column:
    """The parts of a plain text: what stands between Markdown attachments, and these."""
    text, none = F.coalesce(text, F.lit("")), F.lit(None)
    between, attached = F.split(text, ATTACHED, -1), F.regexp_extract_all(text, F.lit(ATTACHED), F.lit(0))
    uri = lambda a: F.regexp_extract(a, ATTACHED, 1)
    kind = lambda a: F.when(uri(a).rlike(SOUND), "audio").when(uri(a).rlike(PAPER), "document").otherwise("image")
    pairs = F.zip_with(between, attached, lambda t, a: F.array(_part(F.lit("text"), t, none, none), F.when(a.isNotNull(), _part(kind(a), none, uri(a), a))))
    return F.filter(F.flatten(pairs), lambda p: p.isNotNull())


def formatted(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, n_tokens, turns) of messages (conv_id, turn, role, parts): turns has (skip, take, attachments) for each
    turn in order; n_tokens is what all placeholders of the conversation stand for."""
    visitor = Visitor(template)
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), visitor.visit)
    one = messages.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), flat.alias("flat"))
    head = F.concat(F.lit(template.turn), template.escaped(F.col("role")), F.lit(template.body))
    pieces, attached = F.transform("flat", lambda x: x["piece"]), F.filter(F.transform("flat", lambda x: x["attachment"]), lambda a: a.isNotNull())
    one = one.select("conv_id", "turn", "role", head.alias("head"), F.array_join(pieces, "").alias("body"), attached.alias("attachments"))
    learned = F.col("role").isin(*template.trained)
    span = F.struct(F.length("head").cast("long").alias("skip"), F.when(learned, F.length("body")).otherwise(0).cast("long").alias("take"), F.col("attachments"))
    place = [F.col("turn").isNotNull().alias("numbered"), "turn", "role", "body"]
    turns = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*place, "head", span.alias("span")))).alias("list"))
    text = F.array_join(F.transform("list", lambda t: F.concat(t["head"], t["body"], F.lit(template.end))), "")
    spans = F.transform("list", lambda t: t["span"])
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.aggregate(t["attachments"], F.lit(0).cast("long"), lambda m, a: m + a["tokens"]))
    return turns.select("conv_id", text.alias("formatted"), spans.alias("turns")).select("conv_id", "formatted", tokens.alias("n_tokens"), "turns")


def read(output: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns) of what formatted() made: role, text, learned text and attachments of each turn, all from the marked text."""

    def restored(body: Column, attachments: Column) -> Column:
        """A body's texts, with the sources of attachments in their places."""
        texts = F.split(body, template.placeholders, -1)
        return F.array_join(F.zip_with(texts, attachments, lambda t, a: F.concat(F.coalesce(template.plain(t), F.lit("")), F.coalesce(a["source"], F.lit("")))), "")

    def turn(cut: Column, span: Column) -> Column:
        two = F.split(cut, re.escape(template.body), 2)
        held, none = span["attachments"], F.array().cast(ATTACHMENTS)
        learned = F.substring(cut, span["skip"].cast("int") + 1, span["take"].cast("int"))
        return F.struct(
            template.plain(F.substring(two[0], len(template.turn) + 1, 2147483647)).alias("role"), restored(two[1], held).alias("text"),
            restored(learned, F.when(span["take"] > 0, held).otherwise(none)).alias("learned"), held.alias("attachments"),
        )

    cuts = F.split("formatted", re.escape(template.end), -1)
    return output.withColumn("cuts", cuts).select("conv_id", F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), "turns", turn).alias("turns"), "formatted", "n_tokens")


def digest(output: DataFrame, template: Template = Template()) -> DataFrame:
    """What the marked texts hold when read back: counts and hashes of turns and of learned text."""
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    told = read(output, template).withColumns({
        "all": F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
        "learned": F.array_join(F.transform("turns", lambda t: t["learned"]), ""),
    })
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hashed(F.col("all")).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        hashed(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
