"""Chat formatting with a grammar round trip. DataFrame functions only.

A turn is written as

    ### Role: text
    </turn>

with role names User, Assistant and System for user, assistant and system, and `@` with the URL-encoded name for any
other role. The parser ends a turn at an unescaped line `</turn>`, reads the role from the start of what stands before it, and takes one
backslash from each control string (`###` or `</turn>`) that has any before it. Texts are written as they are
first; the rendering is parsed and compared with the source, and where it differs the texts in conflict are escaped
by one backslash before the control string and its backslashes, which the parser undoes exactly.

Edge cases. A null text is an empty text, a null role an empty role. Turns are ordered by turn number (null first), then role
and text, and repeated rows are repeated turns. A null conv_id is a conversation of its own. An empty table gives no rows. A conversation is
one value in the result, so one conversation (not one group of conversations) has to fit a row. Extra columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CONTROL = r"(\\*)(###|</turn>)"
END = "\n</turn>\n"
#: Roles with names of their own in the template.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1$2")


def header(role: Column) -> Column:
    name = F.concat(F.lit("@"), F.url_encode(role))
    for k, v in NAMES.items():
        name = F.when(role == k, F.lit(v)).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def rendered(turns: Column, escaped) -> Column:
    """turns: array of (role, text). escaped: turn -> its text as it is written."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), escaped(t), F.lit(END))), "")


def parsed(text: Column) -> Column:
    """The parser: array of (role, text, raw), raw as it stands in the rendering. A piece without a header has a null role."""
    pieces = F.split(text, END, -1)
    whole = F.slice(pieces, 1, F.greatest(F.lit(0), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"\A### (User|Assistant|System|@[^\s:]*): ", 1)
        role = F.when(F.startswith(head, F.lit("@")), F.try_url_decode(F.substring(head, 2, 2**31 - 1)))
        for k, v in NAMES.items():
            role = F.when(head == v, F.lit(k)).otherwise(role)
        raw = F.substr(piece, F.length(head) + F.lit(len("### : ") + 1))
        return F.struct(role.alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(whole, turn)


def recovered(text: Column) -> Column:
    return F.transform(parsed(text), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted for each conversation of rows (conv_id, turn, role, text): raw where the round trip holds, else with the turns in conflict
    escaped, else with all escaped. A rendering that still differs stops the job."""
    x = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns"))
    x = x.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    turns = F.col("turns")
    clash = lambda t: recovered(F.concat(header(t["role"]), t["text"], F.lit(END))) != F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
    steps = [lambda t: t["text"], lambda t: F.when(clash(t), escape(t["text"])).otherwise(t["text"]), lambda t: escape(t["text"])]
    x = x.withColumn("formatted", rendered(turns, steps[0])).withColumn("same", recovered(F.col("formatted")).eqNullSafe(turns))
    for step in steps[1:]:
        x = x.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(turns, step)))
        x = x.withColumn("same", F.col("same") | recovered(F.col("formatted")).eqNullSafe(turns))
    checked = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation differs after its round trip")).cast("string"))
    return x.select("conv_id", checked.alias("formatted"))


def with_loss_mask(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """formatted with its turns read back, and mask: runs (chars, loss) over the formatted text, loss on the texts of role alone."""
    x = formatted.withColumn("turns", parsed(F.col("formatted")))
    runs = F.transform("turns", lambda t: F.array(
        F.struct(F.length(header(t["role"])).alias("chars"), F.lit(False).alias("loss")),
        F.struct(F.length(t["raw"]).alias("chars"), (t["role"] == role).alias("loss")),
        F.struct(F.lit(len(END)).alias("chars"), F.lit(False).alias("loss"))))
    return x.withColumn("mask", F.flatten(runs))


def masked_text(formatted: Column, mask: Column) -> Column:
    """The runs of the formatted text under the loss mask, unescaped, one after the other."""
    # in units of four bytes each, where a run is found without counting from the start
    units = F.encode(formatted, "UTF-32")
    begins = F.aggregate(mask, F.array(F.lit(0)), lambda s, m: F.array_append(s, F.element_at(s, -1) + m["chars"]))
    runs = F.zip_with(mask, F.slice(begins, F.lit(1), F.size(mask)), lambda m, at: F.struct(m["chars"].alias("chars"), m["loss"].alias("loss"), at.alias("at")))

    def cut(both: Column) -> Column:
        shown = F.filter(both["runs"], lambda r: r["loss"])
        return F.transform(shown, lambda r: unescape(F.decode(F.substr(both["units"], 4 * r["at"] + 1, 4 * r["chars"]), "UTF-32")))

    # through an array of one, so that the text is encoded once and not once a run
    return F.array_join(F.element_at(F.transform(F.array(F.struct(units.alias("units"), runs.alias("runs"))), cut), 1), "")


def digests(masked: DataFrame) -> DataFrame:
    """conv_id and the digest columns, from what was read back; the loss ones of what the mask shows of the formatted text."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    x = masked.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        masked_text(F.col("formatted"), F.col("mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return x.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
