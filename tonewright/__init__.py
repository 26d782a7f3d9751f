"""Analytics over time-frequency event detections, written for Spark DataFrames."""
