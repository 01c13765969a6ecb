"""The left words of personal data in small letters: as Spark's ``lower`` gives them,
without the table of all title-cased code points that it builds in a JVM."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from freightlens.llm import pii
from tests.conftest import ROOT


def test_lowered_as_lower(spark):
    """Every code point that a left word can hold: alone, in front and behind; words with irregular letters."""
    point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    letters = spark.range(0x110000).where("id < 55296 or id > 57343").select(point.alias("c")).where(F.col("c").rlike(r"[\p{L}_]"))
    words = letters.select(F.explode(F.array("c", F.concat("c", F.lit("x")), F.concat(F.lit("X"), "c"))).alias("w"))
    words = words.unionByName(spark.createDataFrame([(w,) for w in ("ΟΔΟΣ", "ΣΑΣ_", "Σ", "İSTANBUL", "STRAẞE", "ǅEP", "Größe_Ä", "")], "w string"))
    assert words.count() > 300_000
    assert words.where(~pii.lowered(F.col("w")).eqNullSafe(F.lower("w"))).collect() == []


RUN = """
from pyspark.sql import SparkSession
from freightlens.llm import pii
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
texts = ["Übung: +1 (437) 555-0689 Mail a.b@c.de", "Konto 1234567", None]
docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
print([r.text for r in pii.mask(docs).orderBy("doc_id").collect()])
"""


def test_no_table_of_title_cases(tmp_path):
    log = tmp_path / "classes"
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path),
                        "PYSPARK_SUBMIT_ARGS": f"--driver-java-options -Xlog:class+load:file={log} pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "['Übung: [PHONE] Mail [EMAIL]', 'Konto 1234567', None]" in out.stdout, out.stderr[-2000:]
    classes = log.read_text()
    assert "UTF8String" in classes and "com.ibm.icu.text.RuleBasedBreakIterator" not in classes
