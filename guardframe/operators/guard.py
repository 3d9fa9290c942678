"""Guarded frames: the accepted query forms over tables with sensitive columns.

A guarded frame knows which of its columns are sensitive, by table alias and name.
Expressions are resolved against the frame without them, and none may hold a star, so no
expression can use one; a sensitive column may be selected as it stands, and leaves as
tokens, or be filtered by token. A frame that did either is in sensitive mode. What that mode refuses (DISTINCT,
OFFSET, no limit or a high one, joins that are not inner, conditions that are not AND of
= and IN) is kept with the frame from the first call on, and judged once the mode is
known, so the order of the calls is no matter. All is decided while the plan is built;
Catalyst sees an ordinary frame.

Stars and the forms of conditions are read from Spark's own trees of expressions, through
interfaces of the classic session that are not public; Spark Connect has none of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from guardframe.operators.tokens import empty_vault, filter_by_tokens, mask_output, output_plan
from guardframe.sources.policy import classify_columns

#: Fixed value: the most rows of a result with a sensitive column.
SENSITIVE_LIMIT = 200
_CONVERTER = "org.apache.spark.sql.classic.ColumnNodeToExpressionConverter$"


class GuardError(ValueError):
    """A refused form, with the code of the rule."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class Guard:
    """Entry to guarded frames under one connection's policy and vault."""

    def __init__(self, spark: SparkSession, rules: DataFrame | None = None, vault: DataFrame | None = None, conn: str = "tpch", gen: int = 0, strategy: str = "deterministic"):
        self.spark, self.rules, self.conn, self.gen, self.strategy = spark, rules, conn, gen, strategy
        self.vault = vault if vault is not None else empty_vault(spark)

    def table(self, df: DataFrame, name: str, alias: str | None = None, schema: str | None = None) -> GuardedFrame:
        """A base relation; a column's id is [schema.]table.column. The rules of this guard's connection count."""
        alias, sensitive = alias or name, {}
        if self.rules is not None:
            names = self.spark.createDataFrame([(schema, name, c) for c in df.columns], "schema string, table string, column string")
            # a row for each column of one table
            marked = classify_columns(names, self.rules, self.conn).where("sensitive").collect()
            sensitive = {(alias, r.column): r.col_id for r in marked}
        return GuardedFrame(self, df.alias(alias), sensitive, base=True)

    def values(self, rows: list[tuple], columns: str, alias: str) -> GuardedFrame:
        return GuardedFrame(self, self.spark.createDataFrame(rows, columns).alias(alias), {})


def _parsed(column: Column):
    """The expression of a column before it is resolved."""
    classic = column._jc.getClass().getClassLoader()
    convert = SparkSession.active().sparkContext._jvm.java.lang.Class.forName(_CONVERTER, True, classic).getField("MODULE$").get(None)
    return convert.apply(column._jc.node())


def _has_star(expression) -> bool:
    """A star anywhere but in count(*), which looks at no column."""
    kind = expression.getClass().getSimpleName()
    if kind in ("UnresolvedStar", "UnresolvedRegex", "UnresolvedStarExceptOrReplace", "UnresolvedStarWithColumns", "ResolvedStar"):
        return True
    if kind == "UnresolvedFunction" and not expression.isDistinct() and expression.nameParts().mkString(".").lower() == "count" and expression.children().mkString(",") == "*":
        return expression.children().head().getClass().getSimpleName() != "UnresolvedStar"
    children = expression.children().iterator()
    while children.hasNext():
        if _has_star(children.next()):
            return True
    return False


def _refuse_stars(*expressions: str | Column) -> None:
    """A star would be a list of other columns in the whole frame than in the frame without sensitive ones."""
    for e in expressions:
        if _has_star(_parsed(F.expr(e) if isinstance(e, str) else e)):
            raise GuardError("STAR", str(e))


def _conjuncts(condition) -> list:
    """The parts of an analyzed condition that AND connects."""
    if condition.getClass().getSimpleName() == "And":
        return _conjuncts(condition.left()) + _conjuncts(condition.right())
    return [condition]


def _kind(expression) -> str:
    """The class of an analyzed expression; Spark's own casts to a common type are no part of it."""
    name = expression.getClass().getSimpleName()
    return _kind(expression.child()) if name == "Cast" else name


def _where_faults(df: DataFrame) -> tuple[tuple[str, str], ...]:
    """What sensitive mode refuses of the condition that was filtered by last."""
    out = []
    for part in _conjuncts(df._jdf.queryExecution().analyzed().condition()):
        kind = _kind(part)
        if kind == "Or" or kind == "Not" and _kind(part.child()) not in ("EqualTo", "Like"):
            out.append(("WHERE_NOT_CONJ", part.toString()))
        elif kind not in ("EqualTo", "In", "InSet", "IsNull"):
            out.append(("SENSITIVE_CMP", part.toString()))
    return tuple(out)


def _on_faults(df: DataFrame) -> tuple[tuple[str, str], ...]:
    """What sensitive mode refuses of the condition that was joined by last: it may be AND of = over columns and literals."""
    condition = df._jdf.queryExecution().analyzed().condition()
    if condition.isEmpty():
        return ()
    simple = lambda e: _kind(e) in ("AttributeReference", "Literal")
    bad = [p for p in _conjuncts(condition.get()) if _kind(p) != "EqualTo" or not (simple(p.left()) and simple(p.right()))]
    return tuple(("JOIN_ON_INVALID", p.toString()) for p in bad)


class GuardedFrame:
    """sensitive: column ids by (table alias or None, name); an id of None marks what a derived table hides.

    faults are the codes and details that sensitive mode refuses, in the order of the calls.
    """

    def __init__(self, guard: Guard, df: DataFrame, sensitive: dict, mode: bool = False, limited: int | None = None, faults: tuple = (), base: bool = False, grouped: bool = False):
        self.guard, self.df, self.sensitive, self.mode, self.limited, self.faults, self.base, self.grouped = guard, df, sensitive, mode, limited, faults, base, grouped
        if mode:
            if limited is not None and limited > SENSITIVE_LIMIT:
                raise GuardError("LIMIT_EXCEEDS", str(limited))
            if faults:
                raise GuardError(*faults[0])

    def _with(self, df: DataFrame, **changes) -> GuardedFrame:
        kept = {k: getattr(self, k) for k in ("sensitive", "mode", "limited", "faults", "grouped")}
        return GuardedFrame(self.guard, df, **kept | changes)

    def _entry(self, column: str) -> tuple | None:
        """The key of a sensitive column by name or alias.name; None for others."""
        alias, _, name = column.rpartition(".")
        found = [k for k in self.sensitive if k[1].lower() == name.lower() and (not alias or (k[0] or "").lower() == alias.lower())]
        if len(found) > 1:
            raise GuardError("NO_COLUMN_ALIAS", column)
        if found and self.sensitive[found[0]] is None:
            raise GuardError("SENSITIVE_OUTSIDE_MAIN", column)
        return found[0] if found else None

    def _shown(self) -> DataFrame:
        """The frame without sensitive columns."""
        return self.df.drop(*[F.col(f"{a}.{n}" if a else n) for a, n in self.sensitive]) if self.sensitive else self.df

    def _public(self, code: str, use: Callable[[DataFrame], DataFrame]) -> None:
        """Refuses an expression that the frame without sensitive columns cannot resolve."""
        if not self.sensitive:
            return
        try:
            use(self._shown())
        except AnalysisException as e:
            raise GuardError(code, str(e).split(".")[0]) from e

    def select(self, *items: str | Column | tuple[str, str]) -> GuardedFrame:
        """Columns by name, (name, alias) pairs, or expressions over columns that are not sensitive."""
        out, kept = [], {}
        for item in items:
            name, alias = item if isinstance(item, tuple) else (item, None)
            if isinstance(name, str):
                if name == "*" or name.endswith(".*"):
                    raise GuardError("STAR")
                as_name = alias or name.rpartition(".")[2]
                out.append(F.col(name).alias(as_name))
                if key := self._entry(name):
                    kept[None, as_name] = self.sensitive[key]
            else:
                _refuse_stars(name)
                self._public("SENSITIVE_SELECT_EXPR", lambda df, e=name: df.select(e))
                out.append(name)
        return self._with(self.df.select(*out), sensitive=kept, mode=self.mode or bool(kept))

    def where(self, condition: Column | str) -> GuardedFrame:
        """Rows that a condition holds for; after a grouping it is HAVING, whose form is free."""
        _refuse_stars(condition)
        # a filter would find columns that are only dropped, a projection does not
        self._public("SENSITIVE_CMP", lambda df: df.select(F.expr(condition) if isinstance(condition, str) else condition))
        out = self.df.where(condition)
        return self._with(out, faults=self.faults if self.grouped else self.faults + _where_faults(out))

    def where_token(self, column: str, token: str) -> GuardedFrame:
        return self.where_token_in(column, [token])

    def where_token_in(self, column: str, tokens: list[str]) -> GuardedFrame:
        key = self._entry(column)
        if key is None:
            raise GuardError("PARAM_NON_SENSITIVE", column)
        g = self.guard
        return self._with(filter_by_tokens(self.df, column, self.sensitive[key], tokens, g.vault, g.conn, g.gen), mode=True)

    def join(self, other: GuardedFrame, on: Column, how: str = "inner") -> GuardedFrame:
        """Both frames' columns, told apart by their aliases; a limit from before the join is none of the result's."""
        _refuse_stars(on)
        if self.sensitive or other.sensitive:
            try:
                self._shown().join(other._shown(), on, how)
            except AnalysisException as e:
                raise GuardError("JOIN_ON_SENSITIVE", str(e).split(".")[0]) from e
        out = self.df.join(other.df, on, how)
        faults = self.faults + other.faults + ((("JOIN_NOT_INNER", how),) if how != "inner" else ()) + _on_faults(out)
        return self._with(out, sensitive={**self.sensitive, **other.sensitive}, mode=self.mode or other.mode, limited=None, faults=faults)

    def cross_join(self, other: GuardedFrame) -> GuardedFrame:
        faults = self.faults + other.faults + (("JOIN_NOT_INNER", "cross"),)
        return self._with(self.df.crossJoin(other.df), sensitive={**self.sensitive, **other.sensitive}, mode=self.mode or other.mode, limited=None, faults=faults)

    def _inner(self) -> tuple:
        """The faults of a frame that is a query inside another: it may touch no sensitive column, and needs a limit of its own in that mode."""
        if self.mode:
            raise GuardError("SENSITIVE_OUTSIDE_MAIN")
        limit = ("LIMIT_REQUIRED", "inner query") if self.limited is None else ("LIMIT_EXCEEDS", str(self.limited))
        return self.faults + ((limit,) if self.limited is None or self.limited > SENSITIVE_LIMIT else ())

    def _filter_by(self, other: GuardedFrame, on: Column, how: str) -> GuardedFrame:
        _refuse_stars(on)
        try:
            self._shown().join(other._shown(), on, how)
        except AnalysisException as e:
            raise GuardError("SENSITIVE_CMP", str(e).split(".")[0]) from e
        faults = self.faults + other._inner() + ((("WHERE_NOT_CONJ", how),) if how == "left_anti" else ())
        return self._with(self.df.join(other.df, on, how), faults=faults)

    def semi_join(self, other: GuardedFrame, on: Column) -> GuardedFrame:
        """IN and EXISTS."""
        return self._filter_by(other, on, "left_semi")

    def anti_join(self, other: GuardedFrame, on: Column) -> GuardedFrame:
        """NOT EXISTS."""
        return self._filter_by(other, on, "left_anti")

    def not_in(self, column: str, other: GuardedFrame, key: str) -> GuardedFrame:
        """column NOT IN (other.key) as SQL has it: nothing is left if the list has a null; a null is never in or out of a list that is not empty."""
        _refuse_stars(F.col(column), F.col(key))
        if self._entry(column) or other._entry(key):
            raise GuardError("SENSITIVE_CMP", column)
        keys = other.df.select(F.col(key).alias("_key"))
        # one row, with the number of keys and of nulls among them
        state = keys.agg(F.count("*").alias("_n"), F.count_if(F.col("_key").isNull()).alias("_nulls"))
        anti = self.df.join(keys, F.col(column) == F.col("_key"), "left_anti").crossJoin(F.broadcast(state))
        kept = anti.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull()))
        return self._with(kept.drop("_n", "_nulls"), faults=self.faults + other._inner() + (("WHERE_NOT_CONJ", "not in"),))

    def group_by(self, *keys: str | Column) -> GuardedGroups:
        for k in keys:
            _refuse_stars(F.col(k) if isinstance(k, str) else k)
            self._public("SENSITIVE_LOC", lambda df, k=k: df.groupBy(k).count())
        return GuardedGroups(self, keys)

    def agg(self, *aggregates: Column) -> GuardedFrame:
        return self.group_by().agg(*aggregates)

    def order_by(self, *keys: str | Column) -> GuardedFrame:
        """Ascending keys have nulls last, as PostgreSQL does."""
        keys = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]
        _refuse_stars(*keys)
        self._public("SENSITIVE_LOC", lambda df: df.select(F.row_number().over(W.orderBy(*keys))))
        return self._with(self.df.orderBy(*keys))

    def distinct(self) -> GuardedFrame:
        return self._with(self.df.distinct(), faults=self.faults + (("DISTINCT_SENSITIVE", ""),))

    def distinct_on(self, keys: list[str], order: list[Column]) -> GuardedFrame:
        _refuse_stars(*map(F.col, keys), *order)
        self._public("SENSITIVE_LOC", lambda df: df.select(F.row_number().over(W.partitionBy(*keys).orderBy(*order))))
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        out = self.df.withColumn("_place", place).where("_place = 1").drop("_place")
        return self._with(out, faults=self.faults + (("DISTINCT_SENSITIVE", ""),))

    def limit(self, rows: int) -> GuardedFrame:
        return self._with(self.df.limit(rows), limited=rows if self.limited is None else min(rows, self.limited))

    def offset(self, rows: int) -> GuardedFrame:
        return self._with(self.df.offset(rows), faults=self.faults + (("OFFSET_SENSITIVE", str(rows)),))

    def alias(self, name: str) -> GuardedFrame:
        """A table under another alias; a query as a derived table or CTE, of which no sensitive column comes out."""
        df = self.df.alias(name)
        if self.base:
            return GuardedFrame(self.guard, df, {(name, c): i for (_, c), i in self.sensitive.items()}, base=True)
        return self._with(df, sensitive={(name, c): None for _, c in self.sensitive}, faults=self._inner(), grouped=False)

    def scalar(self) -> Column:
        """The one value of a frame of one row and column, for use in another frame's expressions."""
        if self.mode or self.sensitive:
            raise GuardError("SENSITIVE_OUTSIDE_MAIN")
        return self.df.scalar()

    def result(self) -> tuple[DataFrame, DataFrame]:
        """The frame with tokens for sensitive columns, and the new vault entries."""
        masked = {n: i for (_, n), i in self.sensitive.items()}
        if self.sensitive and not self.mode:
            # the columns that are there unasked count as selected
            if len(set(self.df.columns)) < len(self.df.columns):
                raise GuardError("STAR", "columns of one name")
            GuardedFrame(self.guard, self.df, self.sensitive, True, self.limited, self.faults)
        if (self.mode or self.sensitive) and self.limited is None:
            raise GuardError("LIMIT_REQUIRED")
        if None in masked.values():
            raise GuardError("SENSITIVE_OUTSIDE_MAIN")
        g = self.guard
        return mask_output(output_plan(self.df, masked), g.vault, g.conn, g.gen, g.strategy)

    def to_df(self) -> DataFrame:
        return self.result()[0]


class GuardedGroups:
    def __init__(self, frame: GuardedFrame, keys):
        self.frame, self.keys = frame, keys

    def agg(self, *aggregates: Column) -> GuardedFrame:
        _refuse_stars(*aggregates)
        self.frame._public("SENSITIVE_SELECT_EXPR", lambda df: df.groupBy(*self.keys).agg(*aggregates))
        return self.frame._with(self.frame.df.groupBy(*self.keys).agg(*aggregates), sensitive={}, grouped=True)
