"""Document dataflow on Spark: extraction, segmentation, layout, dispatch and export as DataFrame plans."""
