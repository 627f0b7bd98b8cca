"""lamella: Spark-native quantitative analytics over calibrated 2D-5D images held as relations of voxels."""
