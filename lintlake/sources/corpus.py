"""Code tables built from key columns: the templated test corpus and the labelled sample set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One snippet per template; {k} is the row's key and {m} a small number derived from it.
TEMPLATES: list[tuple[str, str]] = [
    ("py", "def add_{k}(a, b):\n    return a + b\n"),
    ("py", "def total_{k}(items):\n    # sum up\n    s = 0\n    for x in items:\n        s += x * {m}\n    return s\n"),
    ("py", "def pairs_{k}(n):\n    out = []\n    for i in range(n):\n        for j in range({m}):\n            out.append((i, j))\n    return out\n"),
    ("py", "def find_{k}(grid, x):\n    for row in grid:\n        for cell in row:\n            if cell == x:\n                break\n    return {m}\n"),
    ("py", "def cube_{k}(n):\n    c = 0\n    for i in range(n):\n        for j in range(n):\n            for l in range(n):\n                c += {m}\n    return c\n"),
    ("py", "def halve_{k}(n):\n    steps = {m}\n    while n > 1:\n        n //= 2\n        steps += 1\n    return steps\n"),
    ("py", "def search_{k}(arr, t):\n    lo, hi = 0, len(arr) - 1\n    while lo <= hi:\n        mid = (lo + hi) // 2\n        if arr[mid] == t:\n            return mid\n        elif arr[mid] < t:\n            lo = mid + 1\n        else:\n            hi = mid - 1\n    return -{m}\n"),
    ("py", "def fib_{k}(n):\n    if n <= 1:\n        return n\n    return fib_{k}(n - 1) + fib_{k}(n - 2)\n"),
    ("py", "def msort_{k}(a):\n    if len(a) <= 1:\n        return a\n    half = len(a) // 2\n    left = msort_{k}(a[:half])\n    right = msort_{k}(a[half:])\n    return sorted(left + right)\n"),
    ("py", "def fact_{k}(n):\n    return 1 if n <= 1 else n * fact_{k}(n - 1)\n"),
    ("py", "import os\n\n\ndef run_{k}(x):\n    password = \"p{m}\"\n    os.system(x)\n    y = eval(x)\n    return sorted(y)\n"),
    ("py", "def broken_{k}(:\n    return {m}\n"),
    ("py", "class Box{k}:\n    \"\"\"Holds one value.\"\"\"\n\n    limit: int = {m}\n\n    def get(self):\n        \"\"\"Return it.\"\"\"\n        return self.v\n\n    @staticmethod\n    def make(*args, **kw):\n        return Box{k}()\n\n    def get(self, d=None):\n        if self.v and d or self.w:\n            return d\n        return self.v\n"),
    ("py", "def grade_{k}(p):\n    if p > 90:\n        g = 'A'\n    elif p > 80:\n        g = 'B'\n    elif p > 70:\n        g = 'C'\n    else:\n        g = 'D'\n    try:\n        with open(g) as fh:\n            while True:\n                if fh.read({m}):\n                    return g\n    except Exception:\n        assert g\n    return [c for c in g if c if c != g]\n"),
    ("py", "def outer_{k}(xs):\n    for x in xs:\n        pass\n    else:\n        for y in xs:\n            for z in xs:\n                break\n    def inner(q):\n        mid = q\n        return inner(mid)\n    return inner(xs)\n"),
    ("py", "   \n\n"),
    ("c", "/* buffer\n   helpers */\n#include <string.h>\n\nint copy_{k}(char *d, char *s) {\n    int n = {m};\n    if (n) {\n        strcpy(d, s); // unsafe\n    } else {\n        n = 0;\n    }\n    for (n = 0; n < 3; n++) { gets(d); }\n    return n;\n}\n"),
    ("java", "public class A{k} {\n    // entry\n    public static int run{k}(String q) throws Exception {\n        int x = {m};\n        while (x > 0) {\n            x = x - 1;\n        }\n        String s = \"SELECT a FROM t WHERE b=\" + q;\n        return x;\n    }\n}\n"),
    ("js", "function show_{k}(el) {\n  const v = Math.random();\n  do {\n    el.innerHTML = v;\n  } while (v < {m});\n}\nconst go_{k} = (a) => {\n  let t = a;\n  switch (t) { default: return t; }\n};\n"),
    ("py", "async def load_{k}(src):\n    async for part in src:\n        rows = [1, 2]\n    rows.sort()\n    return pick(rows[{m}], '../etc')\n"),
]
LANGUAGE_OF = {"py": "python", "c": "c", "java": "java", "js": "javascript"}


#: Files a task analyses, about: some 10 to 20 seconds of work, however large the table is.
TASK_FILES = 25_000


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Deal the rows to one task per ``rows`` of them (``TASK_FILES`` by default), and to all cores at least.

    Done on the narrow key rows, before text is made of them: their bytes say nothing of the work, so
    their partitions would grow with the table instead of their number, and a row group cannot be split.
    A stream is spread over the cores, because a micro-batch may hold a single file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(cores, key)
    tasks = max(cores, -(-df.count() // (rows or TASK_FILES)))
    return df.repartition(tasks, key) if tasks > cores or df.rdd.getNumPartitions() < cores else df


def template_code(key: Column) -> tuple[Column, Column]:
    """(template number, code text) for a key column."""
    number = (key % len(TEMPLATES)).cast("int")
    text = F.element_at(F.array(*[F.lit(code) for _, code in TEMPLATES]), number + 1)
    small = (key % 97 + 3).cast("string")
    filled = F.replace(F.replace(text, F.lit("{k}"), key.cast("string")), F.lit("{m}"), small)
    return number, filled


def templated_corpus(orders: DataFrame) -> DataFrame:
    """One source file per order key; covers every rule and every language."""
    key = F.col("o_orderkey")
    orders = spread(orders.select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey")
    number, code = template_code(key)
    ending = F.element_at(F.array(*[F.lit(ext) for ext, _ in TEMPLATES]), number + 1)
    languages = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return orders.select(
        key.cast("string").alias("file_id"),
        F.concat(F.lit("src/"), (key % 100).cast("string"), F.lit("/f"), key.cast("string"), F.lit("."), ending).alias("path"),
        F.element_at(languages, ending).alias("language"),
        code.alias("code"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("project"),
        F.concat(F.lit("c"), key.cast("string")).alias("commit_id"),
    )


# The two bodies of the labelled sample set.
BUGGY_BODY = (
    "def calculate_{i}(data):\n    # Missing input validation\n    result = eval(data)\n"
    "    for j in range({n}):\n        result += j\n    return result\n"
)
CLEAN_BODY = (
    "def calculate_{i}(data):\n    if not isinstance(data, (int, float)):\n        return 0\n"
    "    result = data\n    for j in range({n}):\n        result += j\n    return result\n"
)
BUG_RATIO = 0.3


def uniform(key: Column, salt: str) -> Column:
    """A repeatable uniform number in [0, 1) for a key."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def sample_set(numbers: DataFrame, seed: int = 42) -> DataFrame:
    """Labelled code for each number ``i``: about 30 % call eval without validation."""
    i = F.col("i")
    buggy = uniform(i, f"bug{seed}") < BUG_RATIO
    count = F.floor(uniform(i, f"n{seed}") * 100) + 1
    body = F.when(buggy, BUGGY_BODY).otherwise(CLEAN_BODY)
    code = F.replace(
        F.replace(body, F.lit("{i}"), i.cast("string")), F.lit("{n}"), count.cast("string")
    )
    return numbers.select(
        F.lit("synthetic").alias("project"),
        F.format_string("syn_%04d", i).alias("commit_id"),
        buggy.cast("int").alias("target"),
        code.alias("func"),
    )


def synthetic_labels(numbers: DataFrame, bug_ratio: float = BUG_RATIO, seed: int = 42) -> DataFrame:
    i = F.col("i")
    return numbers.select(
        F.format_string("syn_%04d", i).alias("key"),
        (uniform(i, f"label{seed}") < bug_ratio).cast("int").alias("target"),
    )
