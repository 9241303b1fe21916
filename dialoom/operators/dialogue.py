"""Dialogues: normalising turns, pairing questions with answers, building records.

The pairing rule is a state machine in words - the last of several questions holds, only
the first answer after a question counts, other roles are transparent - and a ``lag`` in
relational form: an answer makes a pair iff the user or assistant turn just before it is a
question that is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import basename
from dialoom.functions.scalar import IMAGE_PREFIX
from dialoom.operators.ranking import running_total

# The two role dialects.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt")

#: Turns of one dialogue that one task sorts at most. Longer dialogues are cut into blocks.
BLOCK = 65_536


def is_user(role: Column | str = "role") -> Column:
    return (F.col(role) if isinstance(role, str) else role).isin(*USER_ROLES)


def is_assistant(role: Column | str = "role") -> Column:
    return (F.col(role) if isinstance(role, str) else role).isin(*ASSISTANT_ROLES)


def with_dialogue(df: DataFrame) -> DataFrame:
    """Drop items whose dialogue is missing, null or empty."""
    return df.where(F.size("conversations") > 0)


def with_image(df: DataFrame) -> DataFrame:
    """Drop items whose image could not be stored (``image_ok`` from the image sink)."""
    return df.where(F.col("image_ok"))


def normalise(df: DataFrame) -> DataFrame:
    """Bring both turn dialects to ``role``/``content``; a null falls back like an absent key."""
    fields = df.schema["conversations"].dataType.elementType.fieldNames()

    def pick(t: Column, *names: str) -> Column:
        have = [t.getField(n) for n in names if n in fields]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    return df.withColumn("conversations", F.transform("conversations", lambda t: F.struct(pick(t, "role", "from").alias("role"), pick(t, "content", "value").alias("content"))))


def explode_turns(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per turn: (conv_id, turn, role, content). The image bytes are pruned."""
    return normalise(df.select(key, "conversations")).select(F.col(key).alias("conv_id"), F.posexplode("conversations").alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.content")


def delivered_once(conversations: DataFrame) -> DataFrame:
    """Set repeated deliveries aside: one row per (conv_id, turn), the first loaded one.

    Rows without ``conv_id`` or ``turn`` have no place in a dialogue and are left out.
    """
    w = Window.partitionBy("conv_id", "_block").orderBy("turn", F.col("loaded_at").asc_nulls_last(), "msg_id")
    return (
        conversations.select("conv_id", "turn", "role", "content", "loaded_at", "msg_id")
        .where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .withColumn("_block", F.floor(F.col("turn") / BLOCK))
        .withColumn("_before", F.lag("turn").over(w))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("turn")))
        .drop("_before")
    )


def qa_turns(conversations: DataFrame, keep_empty_question: bool = True) -> DataFrame:
    """(conv_id, turn, question, answer) from delivered turns; ``turn`` is the answer's.

    One shuffle on (conv_id, block) serves both the de-duplication and the pairing, which
    share their sort. A dialogue longer than ``BLOCK`` turns is spread over several tasks;
    the last question-or-answer before each further block is handed over as one extra row.

    A null answer makes a pair; a null question makes none. With ``keep_empty_question``
    false an empty question makes none either. Null roles and all other roles are skipped.
    """
    return _paired(conversations, keep_empty_question).select("conv_id", "turn", "question", "answer")


def _paired(conversations: DataFrame, keep_empty_question: bool = True) -> DataFrame:
    once = delivered_once(conversations)
    turns = once.select("conv_id", "_block", "turn", "role", "content").where(is_user() | is_assistant()).withColumn("_carried", F.lit(False))
    if _has_long(conversations):  # the hand-over rows; without long dialogues there are none
        turns = turns.unionByName(_carried(conversations))
    w = Window.partitionBy("conv_id", "_block").orderBy("turn")
    question = F.lag(F.when(is_user(), F.col("content"))).over(w)
    pairs = turns.withColumn("question", question).where(is_assistant() & F.col("question").isNotNull() & ~F.col("_carried"))
    if not keep_empty_question:
        pairs = pairs.where("question <> ''")
    return pairs.select("conv_id", "_block", "turn", "question", F.col("content").alias("answer"))


def _has_long(conversations: DataFrame) -> bool:
    """Whether any dialogue exceeds a block; answered by Parquet statistics where there are any."""
    return bool(conversations.where(F.col("turn") >= BLOCK).select("turn").limit(1).collect())


def _carried(conversations: DataFrame) -> DataFrame:
    """For each further block of a long dialogue, the last question or answer before it."""
    long = conversations.where(F.col("turn") >= BLOCK).select("conv_id").distinct()
    once = delivered_once(conversations.join(long, "conv_id", "left_semi"))
    last = once.where(is_user() | is_assistant()).groupBy("conv_id", "_block").agg(F.max_by(F.struct("turn", "role", "content"), "turn").alias("t"))
    blocks = once.where("_block > 0").select("conv_id", "_block").distinct()
    w = Window.partitionBy("conv_id").orderBy("_block")
    both = blocks.join(last, ["conv_id", "_block"], "full")
    carried = both.withColumn("t", F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_block > 0 and t is not null")
    return carried.select("conv_id", "_block", "t.turn", "t.role", "t.content", F.lit(True).alias("_carried"))


def qa_pairs_nested(df: DataFrame, key: str = "id", keep_empty_question: bool = True) -> DataFrame:
    """The same rule over nested dialogues, inside each row: no shuffle at all."""
    kept = F.filter(F.transform("conversations", lambda t, i: F.struct(i.cast("bigint").alias("turn"), t.role.alias("role"), t.content.alias("content"))), lambda t: t.role.isin(*USER_ROLES, *ASSISTANT_ROLES))
    good = lambda q: q.isNotNull() if keep_empty_question else (q.isNotNull() & (q != ""))
    paired = F.filter(
        F.transform("_kept", lambda t, i: F.struct(t.turn.alias("turn"), t.role.isin(*ASSISTANT_ROLES).alias("answers"), F.get("_kept", i - 1).alias("before"), t.content.alias("answer"))),
        lambda p: p.answers & p.before.role.isin(*USER_ROLES) & good(p.before.content),
    )
    rows = normalise(with_dialogue(df.select(key, "conversations"))).withColumn("_kept", kept).withColumn("_pairs", paired)
    return rows.select(F.col(key).alias("conv_id"), F.explode("_pairs").alias("p")).select("conv_id", "p.turn", F.col("p.before.content").alias("question"), "p.answer")


def _before(conversations: DataFrame, keep_empty_question: bool) -> DataFrame:
    """(conv_id, _block, _first): the number of pairs before each block of a dialogue. Reads no further than
    whether a text is there, so no text moves."""
    slim = conversations.withColumn("content", F.when(F.col("content") == "", "").when(F.col("content").isNotNull(), "x"))
    counts = _paired(slim, keep_empty_question).groupBy("conv_id", "_block").agg(F.count("*").alias("n"))
    return running_total(counts, ["conv_id", "_block"], "n", "_first")


def samples(conversations: DataFrame, keep_empty_question: bool = True, texts: bool = True) -> DataFrame:
    """The pairs of :func:`qa_turns` with ``id`` = "{conv_id}_{n}", n counting all pairs in (conv_id, turn) order from 0.

    The number of a pair is that of the pairs of earlier dialogues, a sum over one count a dialogue,
    and its place in its own. Texts are shuffled once, for the pairing; without ``texts`` not at all.
    """
    first = _before(conversations, keep_empty_question)
    if not texts:
        conversations = conversations.withColumn("content", F.when(F.col("content") == "", "").when(F.col("content").isNotNull(), "x"))
    w = Window.partitionBy("conv_id", "_block").orderBy("turn")
    pairs = _paired(conversations, keep_empty_question).withColumn("_n", F.row_number().over(w) - 1)
    out = pairs.join(first, ["conv_id", "_block"]).withColumn("id", F.concat_ws("_", F.col("conv_id").cast("string"), (F.col("_first") + F.col("_n")).cast("string")))
    return out.select("conv_id", "turn", *(["question", "answer"] if texts else []), "id")


def with_sample_id(pairs: DataFrame) -> DataFrame:
    """Add ``id`` = "{conv_id}_{n}" to pairs of any origin, n counting all of them in (conv_id, turn) order from 0."""
    counts = pairs.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = running_total(counts, ["conv_id"], "n", "_first")
    numbered = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return numbered.join(first, "conv_id").withColumn("id", F.concat_ws("_", F.col("conv_id").cast("string"), (F.col("_first") + F.col("_n")).cast("string"))).select(*pairs.columns, "id")


def image_name(key: Column | str = "conv_id") -> Column:
    return F.concat(F.lit("image_"), F.col(key).cast("string") if isinstance(key, str) else key, F.lit(".jpg"))


def training_records(samples: DataFrame) -> DataFrame:
    """Format B from (id, conv_id, question, answer)."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return samples.select("id", image_name().alias("image"), F.array(turn("human", F.concat(F.lit(IMAGE_PREFIX), F.col("question"))), turn("gpt", F.col("answer"))).alias("conversations"))


def message_records(samples: DataFrame, folder: str = "images") -> DataFrame:
    """Format A: the picture and the question in one message, the answer in the next."""
    none = F.lit(None).cast("string")
    part = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))
    path = F.concat_ws("/", F.lit(folder), image_name())
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", path, none), part("text", none, F.col("question"))).alias("content"))
    bot = F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, F.col("answer"))).alias("content"))
    return samples.select("id", path.alias("image"), F.array(user, bot).alias("conversations"), F.col("conv_id").alias("original_index"))


def messages_to_records(messages: DataFrame, *keep: str) -> DataFrame:
    """Format A to B: the first text part of the first message, the first part of the second; ``keep`` names further columns."""
    texts = F.filter(F.get("conversations", F.lit(0)).content, lambda c: c.type == "text")
    question = F.coalesce(F.get(texts, F.lit(0)).text, F.lit(""))
    answer = F.get(F.get("conversations", F.lit(1)).content, F.lit(0)).text
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return messages.select("id", basename("image").alias("image"), F.array(turn("human", F.concat(F.lit(IMAGE_PREFIX), question)), turn("gpt", answer)).alias("conversations"), *keep)


def first_of(role: str) -> Column:
    """Value of the first turn with this role in a format-B record; empty if there is none."""
    return F.coalesce(F.get(F.filter("conversations", lambda t: t["from"] == role), F.lit(0)).value, F.lit(""))


def positional(turns: DataFrame) -> DataFrame:
    """The stateless pairing of the statistics: even user turns ask, odd assistant turns answer."""
    even = F.col("turn") % 2 == 0
    kind = F.when(even & is_user(), F.lit("question")).when(~even & is_assistant(), F.lit("answer"))
    return turns.withColumn("kind", kind).where("kind is not null")
