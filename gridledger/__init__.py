"""Spark jobs for fleets of camera-read electricity meters."""
