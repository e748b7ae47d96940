"""Raw CSV to table, sample, validation, CSV again, model and scores."""

from pyspark.sql import functions as F

from airstats.catalog.files import raw_csv
from airstats.plans import models, scoring
from airstats.plans.sampling import sample_flights, validate_sample
from airstats.sources import csv, parquet
from airstats.storage import scratch_path

KEY = ["FL_DATE", "OP_CARRIER", "OP_CARRIER_FL_NUM", "ORIGIN", "CRS_DEP_TIME"]


def test_from_raw_file_to_scores(spark, sf_dir):
    src, table, out = raw_csv(spark, sf_dir), scratch_path(spark, "table"), scratch_path(spark, "sample")
    years = parquet.load_years(spark, src, table, range(1990, 2010))
    assert years == list(range(1990, 2010))
    population = spark.read.parquet(table)

    drawn = sample_flights(population, KEY)
    csv.write_csv(drawn.sample.select(*[F.col(c).alias(c.upper()) for c in drawn.sample.columns]), out)
    sample = csv.read_sample_csv(spark, out)
    assert sample.count() == drawn.sample.count() == drawn.log.agg(F.sum("sampled")).head()[0]
    assert validate_sample(population, sample).peak.head().diff < 0.2

    prepared = models.prepare(sample, KEY, fit_on="all")
    model = prepared.whole(models.fit_logistic(prepared.train, max_iter=20))
    scored = scoring.with_text(scoring.score(model, prepared.test_rows))
    assert scored.count() == prepared.test_rows.count() > 0
