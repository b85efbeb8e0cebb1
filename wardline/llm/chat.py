"""Chat formatting with a grammar round trip.

A conversation is rendered with a template that marks its turns; a deterministic parser reads
the rendered text back, and what it recovers is compared with the source.  Content that holds
control strings is escaped, one level further until the comparison holds:

* level 1 stuffs a backslash into every control string (``<|im_end|>`` -> ``<\\|im_end|>``; a
  string already stuffed gets one more, so removing one backslash each undoes it);
* level 2 percent-encodes every character the template or level 1 gives a meaning, which no
  content can break; a turn so written carries the mark ``%`` before its role.

Only DataFrame functions; one shuffle, on the conversation.

Defined cases: null text and null role are empty; turns are ordered by turn (nulls first), then
role, then text, so ties and repeated rows have one order and all of them stay; a null conv_id is
a conversation of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrowed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Strings that chat templates give a meaning.
CONTROL_STRINGS = (
    "<|im_start|>",
    "<|im_end|>",
    "<|im_sep|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|end|>",
    "<start_of_turn>",
    "<end_of_turn>",
    "<<SYS>>",
    "<</SYS>>",
    "[INST]",
    "[/INST]",
    "<s>",
    "</s>",
    "<unk>",
    "<pad>",
    "<bos>",
    "<eos>",
)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


_FIRST = "[<\\[]"
_REST = "|".join(sorted((_quoted(s[1:]) for s in CONTROL_STRINGS), key=len, reverse=True))
_PLAIN = f"({_FIRST})(\\\\*)({_REST})"
_STUFFED = f"({_FIRST})\\\\(\\\\*)({_REST})"


def stuffed(text: Column) -> Column:
    """Level 1: one backslash after the first character of every control string, stuffed or not."""
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit("$1\\\\$2$3"))


def unstuffed(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_STUFFED), F.lit("$1$2$3"))


def encoded(text: Column) -> Column:
    """Level 2: ``%``, ``<``, ``[``, ``\\`` and line ends as ``%XX``."""
    for char in "%<[\\\n":
        text = F.replace(text, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return text


def decoded(text: Column) -> Column:
    for char in "\n\\[<%":
        text = F.replace(text, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return text


def _rendered_turn(role: Column, text: Column, level: int) -> Column:
    if level == 2:
        return F.concat(F.lit(OPEN + "%"), encoded(role), F.lit("\n"), encoded(text), F.lit(CLOSE))
    return F.concat(F.lit(OPEN), stuffed(role), F.lit("\n"), stuffed(text), F.lit(CLOSE))


#: Turns whose sizes are added up together; keeps long conversations from quadratic work.
STRETCH = 256


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: array of (role, body, text, start, level).

    ``body`` is the content as it stands, from code point ``start`` (from 1); ``text`` undoes the
    escapes.  The grammar: (OPEN role "\\n" body CLOSE)*; OPEN cannot occur inside escaped content.
    """
    pieces = F.split(formatted, _quoted(OPEN))
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))  # each: role "\n" body CLOSE
    sizes = F.transform(pieces, lambda p: F.length(p) + F.lit(len(OPEN)))
    # where a piece begins: whole stretches before it, then pieces before it in its stretch
    stretches = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(sizes) / F.lit(STRETCH)).cast("int")),
        lambda j: _total(F.slice(sizes, j * F.lit(STRETCH) + 1, F.lit(STRETCH))),
    )
    ahead = F.transform(stretches, lambda _, j: _total(F.slice(stretches, F.lit(1), j)))
    whole = F.struct(pieces.alias("pieces"), sizes.alias("sizes"), ahead.alias("ahead"))

    def turns(w: Column) -> Column:
        def turn(p: Column, i: Column) -> Column:
            j = F.floor(i / F.lit(STRETCH)).cast("int")
            at = F.get(w["ahead"], j) + _total(F.slice(w["sizes"], j * F.lit(STRETCH) + 1, i % F.lit(STRETCH))) + F.lit(len(OPEN))
            cut = F.instr(p, "\n")
            head = F.left(p, cut - 1)
            body = F.substring(p, cut + 1, F.length(p) - cut - F.lit(len(CLOSE)))
            marked = F.startswith(head, F.lit("%"))
            return F.struct(
                F.when(marked, decoded(F.substring(head, F.lit(2), F.length(head)))).otherwise(unstuffed(head)).alias("role"),
                body.alias("body"),
                F.when(marked, decoded(body)).otherwise(unstuffed(body)).alias("text"),
                (at + cut + 1).alias("start"),
                F.when(marked, F.lit(2)).otherwise(F.lit(1)).alias("level"),
            )

        return F.transform(w["pieces"], turn)

    return F.flatten(F.transform(F.array(whole), turns))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as :func:`parse` reads them back), identical.

    A turn's content is escaped at the first level at which parsing its rendering alone gives the
    source back; ``identical`` says whether the whole conversation, read back, is the source.
    """
    rows = narrowed(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})

    def held(level: int) -> Column:
        back = parse(F.col(f"r{level}"))
        first = F.get(back, F.lit(0))
        same = (F.size(back) == 1) & (first["role"] == F.col("role")) & (first["text"] == F.col("text"))
        return F.coalesce(same, F.lit(False))

    plain = ~F.startswith(F.col("role"), F.lit("%")) & ~F.contains(F.col("role"), F.lit("\n"))
    # a turn without control strings, braces or backslashes renders as itself: nothing to compare
    quiet = plain & ~F.col("text").rlike(_FIRST) & ~F.col("role").rlike(_FIRST)
    rows = rows.withColumn("r1", _rendered_turn(F.col("role"), F.col("text"), 1))
    rows = rows.withColumn(
        "rendered", F.when(quiet | (plain & held(1)), F.col("r1")).otherwise(_rendered_turn(F.col("role"), F.col("text"), 2))
    )
    source = F.struct("turn", "role", "text", "rendered")
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(source)).alias("source"))
    whole = gathered.select(
        "conv_id", "source", F.array_join(F.col("source")["rendered"], "").alias("formatted")
    ).withColumn("turns", parse(F.col("formatted")))
    told = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", "turns", (told(F.col("source")) == told(F.col("turns"))).alias("identical"))


def with_loss(chats: DataFrame) -> DataFrame:
    """Adds ``loss_spans``: (start, length, level) code-point spans of assistant contents in ``formatted``."""
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == F.lit("assistant")),
        lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).alias("length"), t["level"].alias("level")),
    )
    return chats.withColumn("loss_spans", spans)


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``formatted`` and the loss mask alone."""
    chats = with_loss(chats)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))

    def masked(s: Column) -> Column:
        body = F.substring(F.col("formatted"), s["start"], s["length"])
        return F.when(s["level"] == 2, decoded(body)).otherwise(unstuffed(body))

    chats = chats.withColumn("loss", F.array_join(F.transform("loss_spans", masked), ""))
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "identical",
    )


#: A conversation made of control strings, added to every run of the query.
PROBE = (-1, "</s>[INST] ok [/INST]")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = narrowed(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    probe = spark.range(2).select(
        F.lit(PROBE[0]).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PROBE[1]).alias("text"),
    )
    return rows.unionByName(probe)


def chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return digests(formatted(with_probe(spark, conversations)))


#: The same digests, taken from the source; ``formatted_chars`` counts what the template adds.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE[1]}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE[1]}'
), marked AS (
  SELECT *, length(regexp_replace(text, '{_PLAIN}', '\\1\\\\\\2\\3', 'g')) AS body FROM rows
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(OPEN)} + length(role) + 1 + body + {len(CLOSE)}) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, true AS identical
FROM chats
"""
