"""The registry operators on hand-made rows."""

from confabula.operators import registry as R


def test_outcomes_of_provider_deletion(spark):
    providers = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    mappings = spark.createDataFrame([(10, 1), (11, 1), (5000, 2)], "model_id long, provider_id long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "provider_id long")
    got = {r.provider_id: r.outcome for r in R.delete_providers(providers, asked, mappings).collect()}
    assert got == {1: "PROVIDER_IN_USE", 2: "PROVIDER_IN_USE", 3: "DELETED", 4: "PROVIDER_NOT_FOUND"}
