"""Line-and-outcome analytics as DataFrame functions on Spark."""
