"""SQL text as tokens, and one scan over them that keeps a stack of scopes.

Nothing is parsed to a tree.  A text becomes an array of tokens with a class each; a
statement's tokens are folded from left to right.  The accumulator holds, for the current
parentheses and all around them, the leading verb, whether a table or an operand is due,
and the names that WITH has defined there.  The fold gives the tables a statement names at
any depth, its type, its unsafe parts, and whether it is a statement at all.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments, dollar-quoted texts, literals, quoted names, words, numbers, single signs.
TOKEN = (
    r"--[^\n]*|/\*(?s:.*?)\*/"
    r"|\$((?:[A-Za-z_]\w*)?)\$(?s:.*?)\$\1\$"
    r"|[eEbBxXnN]?'[^']*(?:''[^']*)*'"
    r'|"[^"]*(?:""[^"]*)*"|`[^`]*`|\[[A-Za-z_]\w*\]'
    r"|[\p{L}_][\p{L}\p{N}_$]*|\d+(?:\.\d+)?|\S"
)

# Words by what they do in a statement; every other word is a name.
CLASSES = {
    "SELECT": ["SELECT"], "FROM": ["FROM"], "JOIN": ["JOIN"], "UPDATE": ["UPDATE"],
    "DELETE": ["DELETE"], "INSERT": ["INSERT"], "MERGE": ["MERGE"], "INTO": ["INTO"],
    "TABLE": ["TABLE"], "USING": ["USING"], "WITH": ["WITH"], "AS": ["AS"], "ON": ["ON"],
    "SET": ["SET"], "WHERE": ["WHERE"], "VALUES": ["VALUES"], "DISTINCT": ["DISTINCT"],
    "SETS": ["UNION", "INTERSECT", "EXCEPT"],
    "CLAUSE": ["GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "WINDOW", "RETURNING"],
    "LOGIC": ["AND", "OR"],
    "OPERATOR": ["LIKE", "ILIKE", "IN", "BETWEEN", "BY", "WHEN", "THEN", "ELSE"],
    "NOT": ["NOT"], "IS": ["IS"],
    "DDL": ["DROP", "CREATE", "ALTER", "TRUNCATE"],
    "OTHER": ["GRANT", "REVOKE", "SHOW", "CALL", "COPY", "BEGIN", "COMMIT", "ROLLBACK"],
    "EXPLAIN": ["EXPLAIN", "ANALYZE"],
    "SKIPPED": ["ONLY", "LATERAL", "IF", "EXISTS", "RECURSIVE", "MATERIALIZED"],
    "WORD": ["LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "NATURAL", "FOR", "CASE", "END", "ASC", "DESC"],
    "VALUE": ["NULL", "TRUE", "FALSE", "ALL"],
}
VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "VALUES", "DDL", "OTHER", "EXPLAIN", "TABLE", "SET"]
# What no statement, pair of parentheses or clause can end with.
OPEN_ENDS = [
    "SELECT", "FROM", "JOIN", "INTO", "USING", "WITH", "AS", "ON", "SET", "WHERE", "VALUES", "SETS", "CLAUSE",
    "LOGIC", "OPERATOR", "NOT", "IS", ",", ".",
]

_SCOPE = (
    "struct<table:boolean,n:int,verb:string,due:string,loose:boolean,filtered:boolean,"
    "joined:boolean,assigned:boolean,into:boolean,star:boolean,defined:array<string>>"
)
_STATE = (
    f"struct<cur:{_SCOPE},stack:array<{_SCOPE}>,tables:array<string>,own:array<string>,"
    "broken:boolean,deletes:int,updates:int,sets:string>"
)


def _class_of(token: Column) -> Column:
    words = F.create_map(
        *chain.from_iterable((F.lit(w), F.lit(k)) for k, group in CLASSES.items() for w in group)
    )
    first, long = F.substring(token, 1, 1), F.length(token) > 1
    return (
        F.when(long & token.rlike(r"(?s)^(?:[eEbBxXnN]?'.*'|\$.+\$)$") | token.rlike(r"^\d"), F.lit("VALUE"))
        .when(first.isin('"', "`", "[") & long, F.lit("NAME"))
        .when(first.isin("'", '"', "`"), F.lit("BAD"))
        .when(token.rlike(r"^[\p{L}_]"), F.coalesce(words[F.upper(token)], F.lit("NAME")))
        .when(first.isin("(", ")", ",", ".", ";", "*"), first)
        .when(first.rlike(r"[=<>+\-/%|&^~!:@#]"), F.lit("OPERATOR"))
        .otherwise(F.lit("VALUE"))
    )


def _bare_name(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return (
        F.when(token.rlike('(?s)^".+"$'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(token.rlike(r"(?s)^`.+`$|^\[.+\]$"), inner)
        .otherwise(token)
    )


def sql_tokens(sql: Column) -> Column:
    """``array<struct<k, t>>``: class and text of each token but comments."""
    found = F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(TOKEN), F.lit(0))
    found = F.filter(found, lambda t: ~t.startswith("--") & ~t.startswith("/*"))
    return F.transform(found, lambda t: F.struct(_class_of(t).alias("k"), _bare_name(t).alias("t")))


def statement_bounds(tokens: Column) -> Column:
    """Places of the semicolons, with one before the first and one after the last token."""
    marks = F.transform(tokens, lambda x, i: F.when(x["k"] == ";", i))
    return F.concat(F.array(F.lit(-1)), F.filter(marks, lambda i: i.isNotNull()), F.array(F.size(tokens)))


def split_statements(tokens: Column, bounds: Column) -> Column:
    """The tokens of each statement that has any; both arguments are columns at hand."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(bounds) - 2),
        lambda j: F.slice(tokens, F.get(bounds, j) + 2, F.get(bounds, j + 1) - F.get(bounds, j) - 1),
    )
    return F.filter(pieces, lambda p: F.size(p) > 0)


def in_context(tokens: Column) -> Column:
    """Each token with what it and its neighbours say by themselves, and the text two
    places before (of ``a.b`` at ``b``, the ``a``); ``tokens`` is a column at hand."""

    def told(x: Column, i: Column) -> Column:
        k = x["k"]
        after = F.coalesce(F.get(tokens, i + 1)["k"], F.lit(""))
        before = F.coalesce(F.get(tokens, i - 1)["k"], F.lit(""))
        before2 = F.coalesce(F.get(tokens, i - 2)["k"], F.lit(""))
        return F.struct(
            k.alias("k"),
            x["t"].alias("t"),
            after.alias("after"),
            before.alias("before"),
            before2.alias("before2"),
            F.get(tokens, i - 2)["t"].alias("owner"),
            k.isin(VERBS).alias("verb"),
            before.isin(OPEN_ENDS).alias("open_before"),
            before.isin("LOGIC", "OPERATOR", "NOT", "IS", "ON", ",", ".").alias("bare_before"),
            (
                k.isin("SELECT", "WHERE", "CLAUSE", "LOGIC", "OPERATOR", "NOT", "IS", "VALUES", "SETS", ".")
                | (k == "ON") & (before != "DISTINCT")
            ).alias("wants"),
            k.isin("WHERE", "CLAUSE", "SETS").alias("ends"),
            k.isin("SKIPPED", "TABLE", "NOT", ".").alias("passed"),
            ((k == "FROM") & ~((before == "DISTINCT") & before2.isin("IS", "NOT"))).alias("from"),
            ((k == "DELETE") & (after != "FROM") | (k == "INSERT") & (after != "INTO")).alias("lame"),
        )

    return F.transform(tokens, told)


def used_names(tokens: Column) -> Column:
    """Names of a statement but those given by AS."""
    names = F.filter(tokens, lambda x: (x["k"] == "NAME") & (x["before"] != "AS"))
    return F.array_distinct(F.transform(names, lambda x: x["t"]))


def qualified_names(tokens: Column) -> Column:
    """``struct<owner, name>`` of the last two parts of every dotted name."""
    ends = F.filter(
        tokens, lambda x: (x["k"] == "NAME") & (x["before"] == ".") & (x["before2"] == "NAME") & (x["after"] != ".")
    )
    return F.array_distinct(
        F.transform(ends, lambda x: F.struct(x["owner"].alias("owner"), x["t"].alias("name")))
    )


def _scope(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _new_scope(table: Column, due: Column, loose: Column, defined: Column) -> Column:
    no = F.lit(False)
    return _scope(
        table=table, n=F.lit(0), verb=F.lit(""), due=due, loose=loose, filtered=no, joined=no,
        assigned=no, into=no, star=no, defined=defined,
    )


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of the values, each computed once."""
    return F.get(F.transform(F.array(_scope(**values)), body), F.lit(0))


def _step(acc: Column, x: Column) -> Column:
    """One token.  ``due`` says what must come: ``table``, ``operand``, ``name`` (of a WITH),
    or nothing: ``listed`` (a table of a FROM list, where a comma starts another),
    ``condition`` (of a join, the same), ``body`` (of a WITH) or ``free``."""
    cur, k = acc["cur"], x["k"]
    due, verb = cur["due"], cur["verb"]
    first = (cur["n"] == 0) & (verb == "")
    explained = (verb == "EXPLAIN") & (x["before"] == "EXPLAIN")
    return F.when(k == "(", _opened(acc)).when(k == ")", _closed(acc, x)).otherwise(
        _let(
            lambda f: _passed(acc, x, f),
            starts=(k == "WITH") & (first | explained),
            begins=x["verb"] & (first | explained | (verb == "WITH") & (due == "body") & (x["before"] == ")")),
            # FROM in the parentheses of a function asks for no table
            asked=((verb != "") | cur["table"]) & ~verb.isin("OTHER", "EXPLAIN"),
            listed=due.isin("listed", "condition"),
            sets=(k == "SET") & verb.isin("UPDATE", "MERGE", "INSERT"),
            named=(due == "table") & (k == "NAME") & (x["after"] != "."),
            strict=~cur["loose"],
        )
    )


def _passed(acc: Column, x: Column, f: Column) -> Column:
    """Any token but parentheses."""
    cur, k = acc["cur"], x["k"]
    verb = cur["verb"]
    return _let(
        lambda g: _moved(acc, x, f, g),
        more=(k == ",") & f["listed"],
        from_list=x["from"] & f["asked"],
        joins=(k == "JOIN") & f["asked"],
        into=(k == "INTO") & f["asked"],
        to_table=(
            f["asked"] & (x["from"] | k.isin("JOIN", "INTO"))
            | (k == "USING") & verb.isin("DELETE", "MERGE") & ~cur["joined"]
            | (k == "TABLE") & ((verb == "DDL") | f["begins"])
            | (k == ",") & f["listed"]
            | f["begins"] & ((k == "UPDATE") | (k == "DDL") & (F.upper(x["t"]) == "TRUNCATE"))
        ),
        records=f["named"] & (cur["into"] | (verb == "DDL") | (x["after"] != "(")),
    )


def _moved(acc: Column, x: Column, f: Column, g: Column) -> Column:
    cur, k, stack = acc["cur"], x["k"], acc["stack"]
    due, verb = cur["due"], cur["verb"]
    is_name = k == "NAME"
    ends = x["ends"] | f["sets"] | g["from_list"] | g["joins"] | g["more"]
    wants = x["wants"] & ((k != "ON") | (verb != "INSERT")) | f["sets"] | (k == ",") & ~g["more"]
    wrong = (
        (k == "BAD")
        | (due == "name") & ~is_name & (k != "SKIPPED")
        | (due == "table") & ~is_name & ~x["passed"] & ~(cur["table"] & (f["begins"] | f["starts"]))
        | f["strict"]
        & (
            (due == "operand") & (ends & ~((k == "FROM") & (x["before"] == "SELECT")) | (k == ","))
            | (ends | (k == "LOGIC")) & x["bare_before"]
        )
        | cur["star"] & is_name
        | f["begins"] & x["lame"]
    )
    next_due = (
        F.when(f["starts"], F.lit("name"))
        .when(due == "name", F.when(is_name, F.lit("body")).otherwise(F.lit("name")))
        .when((due == "body") & ~f["begins"], F.when(k == ",", F.lit("name")).otherwise(F.lit("body")))
        .when(g["to_table"], F.lit("table"))
        .when(f["named"], F.when(cur["into"], F.lit("free")).otherwise(F.lit("listed")))
        .when((due == "table") & (x["passed"] | is_name), F.lit("table"))
        .when((k == "ON") & f["listed"], F.lit("condition"))
        .when(f["listed"] & ~x["ends"] & ~k.isin("SELECT", "VALUES") & ~f["sets"], due)
        .when(wants & f["strict"], F.lit("operand"))
        .when((due == "operand") & k.isin("WORD", "SKIPPED", "DISTINCT", "AS"), F.lit("operand"))
        .otherwise(F.lit("free"))
    )
    moved = _scope(
        table=cur["table"],
        n=cur["n"] + 1,
        verb=F.when(f["starts"], F.lit("WITH"))
        .when(f["begins"], F.when(k == "SET", F.lit("OTHER")).otherwise(k))
        .otherwise(verb),
        due=next_due,
        loose=cur["loose"] | f["begins"] & k.isin("DDL", "OTHER", "SET"),
        filtered=cur["filtered"] | (k == "WHERE") & f["asked"],
        joined=cur["joined"] | g["joins"],
        assigned=cur["assigned"] | (k == "SET"),
        into=g["into"] | cur["into"] & ~f["named"],
        star=(k == "*") & x["before"].isin("SELECT", "DISTINCT", ",") & f["asked"] & (due == "operand"),
        defined=F.when((due == "name") & is_name, F.concat(cur["defined"], F.array(F.lower(x["t"]))))
        .otherwise(cur["defined"]),
    )
    own = g["records"] & ~F.array_contains(cur["defined"], F.lower(x["t"]))
    return _scope(
        cur=moved,
        stack=stack,
        tables=F.when(g["records"], F.concat(acc["tables"], F.array(x["t"]))).otherwise(acc["tables"]),
        own=F.when(own, F.concat(acc["own"], F.array(x["t"]))).otherwise(acc["own"]),
        broken=acc["broken"] | wrong,
        deletes=acc["deletes"],
        updates=acc["updates"],
        sets=F.when((k == "SETS") & (F.size(stack) == 0) & (acc["sets"] == ""), F.upper(x["t"]))
        .otherwise(acc["sets"]),
    )


def _opened(acc: Column) -> Column:
    cur = acc["cur"]
    table = cur["due"] == "table"
    return _scope(
        cur=_new_scope(table, F.when(table, F.lit("table")).otherwise(F.lit("free")), cur["loose"], cur["defined"]),
        stack=F.concat(acc["stack"], F.array(cur)),
        tables=acc["tables"],
        own=acc["own"],
        broken=acc["broken"] | (cur["due"] == "name"),
        deletes=acc["deletes"],
        updates=acc["updates"],
        sets=acc["sets"],
    )


def _closed(acc: Column, x: Column) -> Column:
    cur, stack = acc["cur"], acc["stack"]
    verb, depth = cur["verb"], F.size(stack)
    left_open = (
        cur["due"].isin("table", "name")
        | ~cur["loose"] & x["open_before"]
        | (verb == "UPDATE") & ~cur["assigned"]
    )

    def back(above: Column) -> Column:
        due = above["due"]
        return _scope(
            table=above["table"],
            n=above["n"] + 1,
            verb=F.when((above["verb"] == "") & (above["n"] == 0), verb).otherwise(above["verb"]),
            due=F.when(due == "table", F.lit("listed")).when(due == "operand", F.lit("free")).otherwise(due),
            loose=above["loose"],
            filtered=above["filtered"] | cur["filtered"],
            joined=above["joined"],
            assigned=above["assigned"],
            into=above["into"],
            star=F.lit(False),
            defined=above["defined"],
        )

    return _scope(
        # a parenthesis that closes none leaves all as it is
        cur=F.when(depth > 0, F.get(F.transform(F.slice(stack, -1, 1), back), F.lit(0))).otherwise(cur),
        stack=F.when(depth > 0, F.slice(stack, F.lit(1), depth - 1)).otherwise(stack),
        tables=acc["tables"],
        own=acc["own"],
        broken=acc["broken"] | (depth == 0) | left_open,
        deletes=acc["deletes"] + ((verb == "DELETE") & ~cur["filtered"]).cast("int"),
        updates=acc["updates"] + ((verb == "UPDATE") & ~cur["filtered"]).cast("int"),
        sets=acc["sets"],
    )


# Message texts.
STRUCTURE = "Dangerous DDL statement detected: "
UNSAFE = " without WHERE clause — unsafe operation"


def _finish(acc: Column, tokens: Column) -> Column:
    cur = acc["cur"]
    verb, due = cur["verb"], cur["due"]
    word = F.upper(F.get(F.filter(tokens, lambda x: x["k"] != "("), F.lit(0))["t"])
    kind = (
        F.when(verb.isin("DDL", "OTHER") | (word == "EXPLAIN"), F.when(word == "TRUNCATE", F.lit("TRUNCATETABLE")).otherwise(word))
        .when((verb == "SELECT") & (acc["sets"] != ""), acc["sets"])
        .when(verb == "WITH", F.lit("SELECT"))
        .otherwise(verb)
    )
    broken = (
        acc["broken"]
        | (F.size(acc["stack"]) > 0)
        | (verb == "")
        | due.isin("table", "name", "body")
        | (F.element_at(tokens, -1)["k"].isin(OPEN_ENDS) & ~cur["loose"])
        | ((verb == "UPDATE") & ~cur["assigned"])
    )
    bare = ~cur["filtered"]
    deletes = acc["deletes"] + (bare & (verb == "DELETE")).cast("int")
    updates = acc["updates"] + (bare & (verb == "UPDATE")).cast("int")
    dangers = F.concat(
        F.when(verb == "DDL", F.array(F.concat(F.lit(STRUCTURE), word))).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("DELETE" + UNSAFE), deletes),
        F.array_repeat(F.lit("UPDATE" + UNSAFE), updates),
    )
    return F.struct(
        F.coalesce(broken, F.lit(True)).alias("broken"),
        kind.alias("kind"),
        F.array_distinct(acc["tables"]).alias("tables"),
        F.array_distinct(acc["own"]).alias("own_tables"),
        F.nullif(F.array_join(dangers, "; "), F.lit("")).alias("danger"),
    )


def scanned(tokens: Column) -> Column:
    """``struct<broken, kind, tables, own_tables, danger>`` of a statement's tokens (from
    ``in_context``, a column at hand).  ``own_tables`` leaves out names that a WITH defines
    where they are used."""
    empty = F.array().cast("array<string>")
    start = F.struct(
        _new_scope(F.lit(False), F.lit("free"), F.lit(False), empty).alias("cur"),
        F.array().cast(f"array<{_SCOPE}>").alias("stack"),
        empty.alias("tables"),
        empty.alias("own"),
        F.lit(False).alias("broken"),
        F.lit(0).alias("deletes"),
        F.lit(0).alias("updates"),
        F.lit("").alias("sets"),
    ).cast(_STATE)
    return F.aggregate(tokens, start, _step, lambda acc: _finish(acc, tokens))
