"""Word alignment: pairs from similarity (mutual best, repeated for free words, glued leftovers), chunks from pairs, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarities(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """left: group, i, vec. right: group, j, vec. All similarities inside a group, a sentence's words against its translation's."""
    return left.join(right.withColumnRenamed("vec", "vec2"), group).select(group, "i", "j", cosine("vec", "vec2").alias("sim"))


def mutual_best(sims: DataFrame, group: str) -> DataFrame:
    """Pairs that are each other's best; ties go to the lowest index."""
    a = Window.partitionBy(group, "i").orderBy(F.desc("sim"), "j")
    b = Window.partitionBy(group, "j").orderBy(F.desc("sim"), "i")
    return sims.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).where("_a = 1 and _b = 1").drop("_a", "_b")


def iterated_best(sims: DataFrame, group: str) -> DataFrame:
    """A second round of mutual bests among the words that the first left free, of positive similarity."""
    first = mutual_best(sims, group)
    free = sims.join(first.select(group, "i"), [group, "i"], "left_anti").join(first.select(group, "j"), [group, "j"], "left_anti")
    return first.unionByName(mutual_best(free.where("sim > 0"), group))


def glue(sims: DataFrame, pairs: DataFrame, group: str, least: float = 0.3, reach: int = 3) -> DataFrame:
    """A free left word goes to its best right word if a left word within ``reach`` has it and the similarity suffices."""
    free = sims.join(pairs.select(group, "i"), [group, "i"], "left_anti")
    best = free.groupBy(group, "i").agg(F.max_by(F.struct("j", "sim"), F.struct("sim", -F.col("j"))).alias("b")).select(group, "i", "b.j", "b.sim").where(F.col("sim") >= least)
    near = pairs.select(group, F.col("i").alias("i2"), "j")
    return best.join(near, [group, "j"]).where(F.abs(F.col("i") - F.col("i2")).between(1, reach)).select(group, "i", "j", "sim").distinct()


def chunks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys, s (source word), t (target word). One row a target word with its distinct sorted source words."""
    return pairs.where("s >= 0 and t >= 0").groupBy(*keys, "t").agg(F.array_sort(F.collect_set("s")).alias("w"))


def shifted(align: Column, n_words: Column, start: Column) -> Column:
    """Drift: from chunk ``start`` on, every source word moves on by one, around the end."""
    return F.transform(align, lambda c, i: F.struct(c["t0"].alias("t0"), c["t1"].alias("t1"), F.when((i < start) | (n_words <= 0), c["w"]).otherwise(F.transform(c["w"], lambda x: ((x + 1) % n_words).cast("int"))).alias("w")))


def locate(fragments: list[str | None], text: str) -> list[tuple[int, int] | None]:
    """Each fragment's place in the text behind the one before, letters and digits only, whole words only; None where it
    cannot be found. The fold keeps each character's index."""
    at = [i for i, c in enumerate(text) if c.isalnum()]
    folded = "".join(text[i].lower()[:1] for i in at)
    cursor, out = 0, []
    for f in fragments:
        bare = "".join(c.lower()[:1] for c in f or "" if c.isalnum())
        found, k = None, cursor
        while bare and (k := folded.find(bare, k)) >= 0:
            s, e = at[k], at[k + len(bare) - 1] + 1
            if not (k and at[k - 1] == s - 1) and not (k + len(bare) < len(at) and at[k + len(bare)] == e):
                found, cursor = (s, e), k + len(bare)
                break
            k += 1
        out.append(found)
    return out


def resolve_echo(echoes: list[str], words: list[str]) -> list[int]:
    """Echoed source words to indices: 'n:word' if it checks, else the next unused occurrence, the last one when used up."""
    norm = lambda w: w.strip(" \t\n.,;:!?\"'“”‘’«»()[]…—–-").lower()
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(norm(w), []).append(i)
    used: dict[str, int] = {}
    out = []
    for e in echoes:
        n, sep, rest = e.partition(":")
        if sep and n.strip().isdigit() and int(n) < len(words) and norm(words[int(n)]) == norm(rest):
            out.append(int(n))
            continue
        w = norm(rest if sep and n.strip().isdigit() else e)
        if w in places:
            k = used.get(w, 0)
            out.append(places[w][min(k, len(places[w]) - 1)])
            used[w] = k + 1
    return out
