"""Column builders and text segmentation."""
