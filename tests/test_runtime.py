import os

from almudi.core import runtime


def test_tables_go_to_the_named_folder_and_are_swept(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert runtime.shared_dir(spark) == named
    own = f"{named.removeprefix('file://')}/almudi/{spark.sparkContext.applicationId}"
    df = runtime.tabled(spark.range(5), "probe")
    assert df.count() == 5 and os.path.isdir(own)
    assert runtime.cut(spark.range(3)).count() == 3
    assert runtime.sweep(spark) and not os.path.isdir(own)
