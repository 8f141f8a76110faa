"""huskline: Spark jobs that find disabled code in source comments at corpus scale."""
