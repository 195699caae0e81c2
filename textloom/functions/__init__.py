"""Scalar building blocks: capacities, sizers, white space, segmentation."""
