"""A text with an image that fits by its own tokens: before, its last odd character was cut off into a part of its own."""

from pyspark.sql import functions as F

from docloom.operators import structure as S


def test_an_odd_last_character_is_no_window(spark):
    image = "![fig](img/a.png)"
    texts = [image + "x" * (640 - len(image) + more) for more in (0, 1, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    parts = rows.select("id", S.split_element(F.lit("image"), F.col("md"), F.col("md"), 320).alias("parts")).orderBy("id").collect()
    assert [list(map(len, r["parts"])) for r in parts] == [[640], [641], [640, 2]]
