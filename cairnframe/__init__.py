"""cairnframe: analytics over file inventories and mail archives, declared as Spark DataFrames."""
