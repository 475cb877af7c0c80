"""Documents in many shapes, written from a table: each row's document is put together from blocks that its key picks, and the SQL
that states what must be found is put together from the same list of shapes.

A shape is a text and what a parser finds in it, by line. K stands for the row's key, Z for its size, J for the block's place in the
document. Some documents have no blocks, some are empty or null, some end before their last line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Shapes:
    """Blocks between a head and a foot. blocks: (text, rows), a row: (line within the block, values, texts with {K}, {Z}, {J})."""

    head: str
    foot: str
    blocks: list[tuple[str, list[tuple]]]
    path: str  # with {K}

    def documents(self, part: DataFrame) -> DataFrame:
        """path, content of part's rows (p_partkey, p_size)."""
        k, z = F.col("p_partkey"), F.col("p_size").cast("string")
        texts = F.array(*(F.lit(text) for text, _ in self.blocks))

        def block(j: Column) -> Column:
            text = F.get(texts, ((k * 7 + j * 5 + F.floor(k / 11)) % len(self.blocks)).cast("int"))
            for name, value in (("{K}", k.cast("string")), ("{Z}", z), ("{J}", j.cast("string"))):
                text = F.replace(text, F.lit(name), value)
            return text

        count = F.when(k % 13 == 0, 0).otherwise(k % 5 + 1)
        blocks = F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("long"), count.cast("long")), block)).otherwise(F.array().cast("array<string>"))
        head = F.replace(F.replace(F.lit(self.head), F.lit("{K}"), k.cast("string")), F.lit("{Z}"), z)
        foot = F.when(k % 19 == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit(self.foot)))
        whole = F.array_join(F.concat(F.array(head), blocks, foot), "\n")
        content = F.when(k % 17 == 3, F.lit(None)).when(k % 17 == 5, "").otherwise(whole)
        return part.select(F.replace(F.lit(self.path), F.lit("{K}"), k.cast("string")).alias("path"), content.alias("content"))

    def sql(self, columns: str, more: str = "", rows: list[list[tuple]] | None = None) -> str:
        """What is found, as SQL over part: path, line_number and ``columns`` (name type, …). ``rows``: other rows than the shapes' own;
        ``more``: SQL added to the result, over the CTEs docs (k, z, cnt, cut) and placed (k, z, j, s, base)."""
        heads, sizes = self.head.count("\n") + 1, ", ".join(str(text.count("\n") + 1) for text, _ in self.blocks)
        names = [c.split()[0] for c in columns.split(",")]
        types = [c.split()[1] for c in columns.split(",")]
        value = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
        found = [(s, *r) for s, own in enumerate(rows or [r for _, r in self.blocks]) for r in own]
        values = ", ".join(f"({s}, {line}, {', '.join(map(value, vs))})" for s, line, *vs in found) or f"(-1, 0{', NULL' * len(names)})"
        filled = lambda c: f"replace(replace(replace({c}, '{{K}}', CAST(k AS VARCHAR)), '{{Z}}', CAST(z AS VARCHAR)), '{{J}}', CAST(j AS VARCHAR))"
        picked = ", ".join(f"CAST({filled('c' + str(i))} AS {t}) AS {name}" for i, (name, t) in enumerate(zip(names, types, strict=True)))
        path = "replace('" + self.path + "', '{K}', CAST(k AS VARCHAR))"
        return f"""
            WITH docs AS (SELECT p_partkey AS k, p_size AS z, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_partkey % 5 + 1 END AS cnt, p_partkey % 19 = 7 AS cut FROM part WHERE p_partkey % 17 NOT IN (3, 5)),
            blocks AS (SELECT k, z, unnest(range(1, cnt + 1)) AS j FROM docs),
            chosen AS (SELECT k, z, j, (k * 7 + j * 5 + k // 11) % {len(self.blocks)} AS s FROM blocks),
            placed AS (SELECT *, {heads} + coalesce(sum([{sizes}][s + 1]) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM chosen),
            expected(s, line{''.join(f', c{i}' for i in range(len(names)))}) AS (VALUES {values}),
            ends AS (SELECT docs.k, docs.z, docs.cut, {heads} + coalesce(sum([{sizes}][chosen.s + 1]), 0) AS lines FROM docs LEFT JOIN chosen ON chosen.k = docs.k GROUP BY 1, 2, 3)
            SELECT {path} AS path, CAST(base + line AS INTEGER) AS line_number, {picked} FROM placed JOIN expected ON expected.s = placed.s {more.replace('PATH', path)}"""


def config_shapes(tag: str, kind: str, key: str, parent: str | None, root: str, own: list[tuple[str, list[tuple]]]) -> Shapes:
    """Shapes of one kind of config entity: well and badly formed, nested, commented, foreign, and the kind's own. Rows: (line, kind of
    row, what, value, context)."""
    plain: list[tuple[str, list[tuple]]] = [
        ('<E K="n{K}_{J}"/>', [(1, "n{K}_{J}", "")]), ('<!-- <E K="no{K}"/>\n<property name="no"/> -->', []), ('<E other="x"><property name="A" value="B"/></E>', []),
        ('<E K="ü漢{K}_{J}">\n<property name="Größe &amp; {Z}" value="&lt;{Z}&gt;"/>\n</E>', [(1, "ü漢{K}_{J}", ""), (2, "property", "Größe & {Z}", "<{Z}>", "")]),
        ('<E K="c{K}_{J}">\n<property class="Action{Z}">\n<property name="Inner" value="v"/>\n</property>\n<property name="Last" value="{Z}"/>\n</E>',
         [(1, "c{K}_{J}", ""), (2, "property", "", "", "Action{Z}"), (3, "property", "Inner", "v", "Action{Z}"), (5, "property", "Last", "{Z}", "")]),
        ('<E K="d{K}_{J}">\n<property class="A">\n<property class="B">\n<property name="Deep" value="x"/>\n</property></property></E>', [(1, "d{K}_{J}", ""), (2, "property", "", "", "A"), (3, "property", "", "", "A")]),
        ('<E K=""/>', []), ('<E K="r{K}_{J}">\n<property name="SoundIdle" value="s{Z}"/><property name="BuffOnEat" value=""/></E>',
         [(1, "r{K}_{J}", ""), (2, "property", "SoundIdle", "s{Z}", ""), (2, "property", "BuffOnEat", "", ""), (2, "reference", "sound", "s{Z}", "property:SoundIdle")]),
        ('<E\n  other="1"\n  K="w{K}_{J}"\n/>', [(1, "w{K}_{J}", "")]), ('<E K="p{K}_{J}"/><E K="q{K}_{J}"/>', [(1, "p{K}_{J}", ""), (1, "q{K}_{J}", "")]), ('<E K="o{K}_{J}">\n<E K="i{K}_{J}"/>\n</E>', [(1, "o{K}_{J}", "")]),
    ]
    if parent:
        plain.append(('<E K="h{K}_{J}" PARENT="base{Z}"></E>', [(1, "h{K}_{J}", "base{Z}")]))
    blocks = []
    for text, rows in plain + own:
        full = []
        for row in rows:
            if len(row) == 3:  # a definition, with what follows from it
                line, name, extends = row
                full.append((line, "definition", kind, name, extends))
                if kind == "recipe":
                    full.append((line, "reference", "item", name, "recipe_output"))
                if extends:
                    full.append((line, "reference", kind, extends, "extends"))
            else:
                full.append(row)
        blocks.append((text.replace("<E", f"<{tag}").replace("</E>", f"</{tag}>").replace(" K=", f" {key}=").replace(" PARENT=", f" {parent}="), full))
    return Shapes(f"<{root}>", f"</{root}>", blocks, "f{K}.xml")
