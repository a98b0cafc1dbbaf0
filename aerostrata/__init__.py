"""Exposure tables from gridded, swath and station observations, and corpus operators beside them, on Spark."""
