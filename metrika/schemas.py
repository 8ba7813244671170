"""Schemas of the tables that are read and written, as Spark DDL."""

# Column and field names.
POINT = "struct<x:double,y:double>"
MEASUREMENTS = (
    "Filename string, Date string, Metadata_Experiment string, Metadata_Plate string, Magnification string, Metadata_Well string,"
    " Worm_ID string, Length_um double, Width_um double, Topology_Warnings string"
)
MATCHED = (
    "human_file string, computer_file string, iou double, length_um_human double, width_um_human double, length_um_computer double,"
    " width_um_computer double, length_diff_um double, width_diff_um double, abs_length_diff_um double, abs_width_diff_um double"
)
ROI = (
    "struct<source_image:string,original_width:int,original_height:int,detection_index:int,class_id:int,class_name:string,"
    "confidence:double,bbox_original:array<double>,roi_center_original:array<double>,roi_top_left:array<int>,"
    "roi_size_original:int,output_image_size:int,scale_factor:double,output_image_path:string>"
)
CATALOG = f"map<string,{ROI}>"
SUMMARY = (
    "human_dir string, computer_dir string, iou_threshold double, resize_mismatched boolean, num_human_masks int, num_computer_masks int,"
    " num_matched int, num_unmatched_human int, num_unmatched_computer int, mean_iou_of_matches double, max_iou double"
)
COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string>>,"
    " annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,segmentation:string>>,"
    " categories array<struct<id:int,name:string,supercategory:string>>"
)
WELLS = "strain string, concentration_um double, median_wormlength_um double, median_wormlength_um_reg double, median_wormlength_um_reg_delta double"
