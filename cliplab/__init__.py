"""cliplab: labelled-item dataset preparation and classifier evaluation on Spark.

Items ("frames") are grouped in clips, clips in patients (or any other leakage
group).  Every operator takes DataFrames and returns a lazy DataFrame.
"""
