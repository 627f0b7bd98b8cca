"""Readers and writers: headerless raw volumes, binary STL, ROI tables, header tags."""
