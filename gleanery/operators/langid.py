"""Language by function words: the language whose short word list a text hits most often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Own short lists; the order of the languages settles ties. Replace or extend them by parameter.
FUNCTION_WORDS = {
    "english": "the of and to in is that it for was on with as be at by this have from or are not but which were their",
    "arabic": "في من على أن إلى هذا التي الذي عن مع ما لا كان هذه",
    "danish": "og det at en den til er som på de med han af for ikke der var",
    "dutch": "de het een van en in is dat op te zijn met niet voor aan er om",
    "finnish": "ja on ei se että oli hän joka mutta ovat tämä kun niin myös",
    "french": "le la les des du et est une que qui dans pour pas sur au avec ce il elle en de plus par",
    "german": "der die das und ist nicht ein eine zu den mit von sich auf für im dem auch es als bei",
    "hungarian": "az egy és hogy nem is ez volt meg de csak mint már van",
    "italian": "il la che di è un una per non sono con del della nel gli anche le come si lo",
    "norwegian": "og det er på som en til å ikke med av for jeg har at vi",
    "portuguese": "o os que e do da em um para com não uma no na se por mais as dos",
    "romanian": "și în de la cu nu pe este un o care din să mai sau",
    "russian": "и в не на что он с как это по но она к из у за от",
    "spanish": "el los las que y en un por con no una su para es al lo como más pero sus de la",
    "swedish": "och det att som en på är av för med till den inte har var",
}


def detect(docs: DataFrame, key: str, text: str, lists: dict[str, str] | None = None) -> DataFrame:
    """key, language, hits: english with 0 hits where nothing is hit, and for null texts."""
    found = lists or FUNCTION_WORDS
    spark = docs.sparkSession
    rows = [f"{lang}\t{i}\t{w}" for i, lang in enumerate(found) for w in sorted(set(found[lang].split()))]
    lines = spark.range(1).select(F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("line")).select(F.split("line", "\t").alias("p"))
    words = lines.select(F.col("p")[0].alias("language"), F.col("p")[1].cast("int").alias("pos"), F.col("p")[2].alias("word"))
    tokens = docs.select(key, F.explode(T.every(F.lower(T.text_of(text)), r"[\p{L}]+")).alias("word"))
    hits = tokens.join(F.broadcast(words), "word").groupBy(key, "language", "pos").agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "pos")
    best = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(key, "language", "hits")
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("language", F.lit("english")).alias("language"), F.coalesce("hits", F.lit(0)).alias("hits"))
