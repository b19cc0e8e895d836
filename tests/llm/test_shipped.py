"""A driver that alone knows where the package lies: operators on a caller's own tables find it in their workers."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

CODE = """
import sys
sys.path.insert(0, {root!r})
import public_tokenizers
from pyspark.sql import SparkSession, functions as F
from corrobora.llm import chat, convrepair, decontam, epsgrid, filteraudit, langid, lm, neardup, tokenbin, topk, toxicity
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = s.createDataFrame([(i, f"some words of the text number {{i}} and more of them", "en" if i % 2 else "de", i % 2) for i in range(40)], "doc_id long, text string, lang string, n long")
talk = s.createDataFrame([(1, i, ("user", "assistant")[i % 2], "Text.") for i in range(4)], "conv_id long, turn long, role string, text string")
vectors = s.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
labels = docs.select("doc_id", F.lit(1).alias("quality"), F.col("n").alias("toxic"))
learn = F.col("doc_id") % 3 > 0
print("rows", neardup.near_duplicates(docs).count(), topk.exact_topk(vectors, F.col("vec_id") == 0).count(), chat.digest(chat.render_turns(talk)).count())
print("rows", docs.select(langid.language_of(langid.fit(docs, learn), F.col("text"))).count(), docs.select(toxicity.toxicity_of(toxicity.fit(docs, labels, learn), F.col("text"))).count())
print("rows", decontam.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3), into="c").where("c.contaminated").count() > 0, lm.score(docs, ~learn).count())
print("rows", tokenbin.read_documents(tokenbin.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)).count(), convrepair.repair_digest(convrepair.damage(talk)).count(), epsgrid.near_vectors(vectors).count(), filteraudit.audit(docs, labels).count())
"""


def test_operators_reach_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    more = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT]
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env | ({"PYTHONPATH": ":".join(more)} if more else {}), capture_output=True, text=True, timeout=600)
    assert [x for x in out.stdout.splitlines() if x.startswith("rows")] == ["rows 40 5 1", "rows 40 40", "rows True 40", "rows 40 1 9 1200"], out.stderr[-3000:]
