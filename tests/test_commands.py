"""The commands end to end, and the entry points with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from skald import __main__ as commands
from skald.operators import refresh
from skald.sources import interchange

REPO = Path(__file__).resolve().parents[1]
TEXT = "Клетка растений содержит хлоропласты и ядро, а клетки животных содержат митохондрии."


def test_pages_to_hits(spark, tmp_path, capsys):
    at = str(tmp_path)
    rows = [(f"http://ru.wikipedia.org/{i}", f'<h1>Имя {i}</h1><div class="mw-parser-output"><p>{TEXT} {w}</p></div>') for i, w in enumerate(["альфа бета", "альфа", "гамма 2024"])]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{at}/pages")
    commands.main(["crawl", f"{at}/pages", f"{at}/store", "--now", "1000000000", "--min-words", "5"])
    store = spark.read.schema(refresh.STORE).parquet(f"{at}/store")
    assert {r["metadata"]["title"] for r in store.collect()} == {"Имя 0", "Имя 1", "Имя 2"}
    commands.main(["crawl", f"{at}/pages", f"{at}/store2", "--store", f"{at}/store", "--now", "1000000010", "--min-words", "5"])
    assert spark.read.parquet(f"{at}/store2").filter(F.col("updated_at") == 1_000_000_000).count() == 3
    commands.main(["export", f"{at}/store", f"{at}/corpus"])
    assert interchange.read_corpus(spark, f"{at}/corpus").count() == 3
    commands.main(["tokenize", f"{at}/corpus", f"{at}/tokens"])
    commands.main(["stem", f"{at}/tokens/tokens.tsv", f"{at}/tokens/stems.tsv"])
    commands.main(["zipf", f"{at}/tokens/stems.tsv", f"{at}/zipf", "5"])
    ranks = interchange.read_zipf(spark, f"{at}/zipf/zipf_rank_freq.tsv").orderBy("rank").collect()
    assert (ranks[0]["rank"], ranks[0]["freq"]) == (1, 6)  # клетка, клетки
    commands.main(["index", f"{at}/corpus", f"{at}/index"])
    (tmp_path / "queries").write_text("альфа && !бета\nАЛЬФА || гамма\nнет\n")
    capsys.readouterr()
    commands.main(["search", f"{at}/queries", "--index", f"{at}/index"])
    shown = capsys.readouterr().out.split("\n\n")
    assert ["Имя 1" in shown[0], "Имя 0" in shown[0], shown[1].count("Имя"), "nothing found" in shown[2]] == [True, False, 3, True]
    commands.main(["index", f"{at}/corpus", f"{at}/stemmed", "--stemmed"])
    (tmp_path / "inflected").write_text("КЛЕТКАМИ && \"содержат,\"\nмитохондрия && !бета.\nи ядра\n")
    capsys.readouterr()
    commands.main(["search", f"{at}/inflected", "--index", f"{at}/stemmed"])
    assert [s.count("Имя") for s in capsys.readouterr().out.split("\n\n")] == [3, 2, 3, 0]
    commands.main(["plot", f"{at}/zipf/zipf_rank_freq.tsv", f"{at}/plot", "--picture", f"{at}/zipf.png"])
    assert spark.read.option("header", True).csv(f"{at}/plot/zipf_plot.tsv", sep="\t").columns == ["log10_rank", "log10_freq", "log10_zipf"]
    commands.main(["stats", "--corpus", f"{at}/corpus", "--tokens", f"{at}/tokens/tokens.tsv", "--docs-idx", f"{at}/tokens/docs.idx", "--out", f"{at}/stats", "--top", "3"])
    assert "Documents: 3" in capsys.readouterr().out


def test_entry_without_the_training_data_operators():
    code = "import sys; sys.modules['skald.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout
    assert out.split(maxsplit=1)[1].strip() == "[] True"


def test_flagship(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "title", "url"] and found.count() > 0
